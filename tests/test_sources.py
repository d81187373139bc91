import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs

import pytest
from pyspark.sql import functions as F

from lexispark.plans.sparql import Filter, Lit, Modifiers, Pattern, Query, Ref, Triple, Union, Var, call
from lexispark.plans.sparql_text import SparqlError, load_query, parse_query
from lexispark.sources import endpoint, rdf

RESULT = {"head": {"vars": ["book", "title"]}, "results": {"bindings": [{"book": {"type": "uri", "value": "http://x/1"}, "title": {"type": "literal", "value": "One \"1\"", "xml:lang": "en"}}, {"book": {"type": "uri", "value": "http://x/2"}}]}}


def test_results_in_json(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(RESULT, indent=4))
    (tmp_path / "b.json").write_text(json.dumps({"head": {"vars": ["book", "title"]}, "results": {"bindings": []}}))
    got = rdf.sparql_json(spark, str(tmp_path))
    assert got.columns == ["book", "book_type", "book_lang", "title", "title_type", "title_lang"]
    assert sorted(map(tuple, got.collect())) == [("http://x/1", "uri", None, 'One "1"', "literal", "en"), ("http://x/2", "uri", None, None, None, None)]
    rows = spark.createDataFrame([("http://x/1", "a"), ("http://x/2", None)], "book string, title string")
    made = rdf.result_json(rows)
    back = rdf.bindings(made, "result", rdf.variables(made, "result"))
    assert sorted(back.select("book", "book_type", "title").collect()) == [("http://x/1", "uri", "a"), ("http://x/2", "uri", None)]


def test_triples_by_predicate(spark, tmp_path):
    triples = spark.createDataFrame([("a", "http://p/x", "1", None), ("a", "y", "2", "en")], "s string, p string, o string, o_lang string")
    rdf.write_triples(triples, str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert [tuple(r) for r in back.where("p = 'http://p/x'").select("s", "p", "o", "o_lang").collect()] == [("a", "http://p/x", "1", None)]
    assert [r["o"] for r in parse_query("SELECT ?o { ?s <y> ?o }").to_df(back).collect()] == ["2"]


def test_name_lists(spark, tmp_path):
    (tmp_path / "n.csv").write_text('year,name,percent,sex\n"1880","Ann",0.01,"girl"\n"1880","Sam",0.02,"boy"\n"1881","sam ",0.0006,"girl"\n"1881","Rare",0.0004,"boy"\n')
    rows = rdf.name_frequencies(spark, str(tmp_path / "n.csv"))
    assert rows.count() == 3
    assert sorted(map(tuple, rdf.names_by_sex(rows).collect())) == [("ann", False, True), ("sam", True, True)]
    (tmp_path / "t.out").write_text('Query Results (2 answers):\nperson | "name"\n------\nx1 | "Tom | Smith"\nx2 | "Ann"\nno cell\n')
    assert sorted(r["name"] for r in rdf.text_table(spark, str(tmp_path / "t.out")).collect()) == ["Ann", "Tom | Smith", "name"]


class Endpoint(BaseHTTPRequestHandler):
    """Three books, in pages if asked."""

    def do_POST(self):
        query = parse_qs(self.rfile.read(int(self.headers["Content-Length"])).decode())["query"][0]
        m = parse_query(query).modifiers
        rows = [{"b": {"type": "uri", "value": f"u{i}"}, **({"n": {"type": "literal", "value": f"n{i}"}} if i else {})} for i in range(3)]
        rows = rows[m.offset or 0 :][: m.limit]
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps({"head": {"vars": ["b", "n"]}, "results": {"bindings": rows}}).encode())

    def log_message(self, *args):
        pass


def test_endpoint(spark):
    server = HTTPServer(("127.0.0.1", 0), Endpoint)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    endpoint.register(spark)
    read = spark.read.format("sparql").option("endpoint", f"http://127.0.0.1:{server.server_port}/").option("query", "SELECT ?b ?n WHERE { ?b <label> ?n } ORDER BY ?b")
    expected = [("u0", None), ("u1", "n1"), ("u2", "n2")]
    assert sorted(map(tuple, read.load().collect())) == expected
    assert sorted(map(tuple, read.option("pagesize", 1).option("pages", 2).load().collect())) == expected
    server.shutdown()


E, N, B, C = Var("entity"), Var("name"), Var("book"), Var("books")

#: The parts of the model in one query, as text.
WHOLE = """PREFIX rdfs: <http://www.w3.org/2000/01/rdf-schema#>
PREFIX p: <http://p/>
SELECT ?entity ?name (COUNT(?book) AS ?books)
WHERE {
  ?book p:author ?entity .
  ?entity rdfs:label ?name .
  {
    ?entity rdfs:label1 ?name .
  } UNION {
    ?entity rdfs:label2 ?name .
  }
  OPTIONAL {
    ?book p:genre ?genre .
    FILTER ((?genre != ?name))
  }
  FILTER (langMatches(lang(?name), "EN"))
}
GROUP BY ?entity ?name ?books
HAVING ((COUNT(?book) > 1))
ORDER BY DESC(?books)
LIMIT 5000
OFFSET 2"""


def whole():
    q = Query().namespace("rdfs:", "http://www.w3.org/2000/01/rdf-schema#").namespace("p:", "http://p/")
    label = q.referent("rdfs:label")
    q.add(Triple(B, q.referent("p:author"), E), Triple(E, label, N), Filter(call("langMatches", call("lang", N), Lit("EN"))))
    q.add(Union([Pattern().add(Triple(E, Ref(label.uri + str(i)), N)) for i in (1, 2)]))
    q.add(Pattern().add(Triple(B, q.referent("p:genre"), Var("genre"))).add(Filter(call("!=", Var("genre"), N))))
    q.output(E, N, C).aggregate("COUNT", B, C).group(E, N, C)
    q.having = call(">", call("COUNT", B), 1)
    q.modifiers = Modifiers(order=[(C, True)], limit=5000, offset=2)
    return q


def test_text_of_a_whole_query_and_back():
    assert whole().to_sparql() == WHOLE
    assert parse_query(WHOLE).to_sparql() == WHOLE


#: As people write them: no space before the dots, predicate lists, `a`, dots after filters.
WRITTEN = """
PREFIX g:<http://g/>  # a comment
SELECT DISTINCT ?entity ?name WHERE{
    ?book g:genre ?entity;
        a g:Book.
    ?entity g:label ?name, ?other.
    FILTER langMatches( lang(?name), "EN" ).
    FILTER (!(?name = 'x') && strlen(?name) >= 1 || ?name = "a\\"b"@en)
}
LIMIT 5"""


def test_texts_as_people_write_them(spark, tmp_path):
    (tmp_path / "q.sparql").write_text(WRITTEN)
    q = load_query(str(tmp_path / "q.sparql"))
    assert len(q.where.triples) == 4 and q.modifiers.distinct and q.modifiers.limit == 5 and q.where.triples[1].p == Ref("rdf:type")
    triples = spark.createDataFrame([("b1", "http://g/genre", "sf", None), ("b1", "rdf:type", "http://g/Book", None), ("sf", "http://g/label", "Sci", "en"), ("sf", "http://g/label", "Zuk", "de"), ("b2", "http://g/genre", "sf", None)], "s string, p string, o string, o_lang string")
    assert [tuple(r) for r in q.to_df(triples).collect()] == [("sf", "Sci")]
    lang = parse_query('SELECT ?s WHERE { ?s <http://g/label> "Zuk"@de }')
    assert [r["s"] for r in lang.to_df(triples).collect()] == ["sf"] and parse_query('SELECT ?s { ?s <http://g/label> "Zuk"@en }').to_df(triples).isEmpty()


@pytest.mark.parametrize("text", ["", "SELECT", "SELECT ?a", "SELECT ?a WHERE { ?a ?b }", "ASK { ?a ?b ?c }", "SELECT ?a { ?a x:y ?c }", "SELECT (?a + 1 AS ?b) { ?a ?b ?c }", "SELECT ?a { ?a ?b ?c } LIMIT x", "SELECT ?a { ?a ?b ?c } rest", "PREFIX a: b SELECT ?a { ?a ?b ?c }"])
def test_texts_that_are_no_query(text):
    with pytest.raises(SparqlError):
        parse_query(text)


ROWS = [("b1", "by", "x", None), ("b2", "by", "x", None), ("b3", "by", "y", None), ("b1", "pages", "3", None), ("b2", "pages", "30", None), ("x", "name", "Ann", "en"), ("b1", "title", "Ann", "en"), ("b2", "title", "Bob", "en")]


@pytest.fixture
def books(spark):
    return spark.createDataFrame(ROWS, "s string, p string, o string, o_lang string")


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_aggregates_and_orders(books):
    ask = lambda text: rows(parse_query(text).to_df(books))
    assert ask("SELECT ?a (COUNT(*) AS ?n) { ?b <by> ?a } GROUP BY ?a ORDER BY DESC(COUNT(?b)) ?a") == [("x", 2), ("y", 1)]
    assert ask("SELECT ?a { ?b <by> ?a } GROUP BY ?a HAVING (COUNT(?b) > 1)") == [("x",)]
    assert ask("SELECT ?b { ?b <pages> ?p } ORDER BY strlen(?p) DESC(?b)") == [("b1",), ("b2",)]
    assert ask("SELECT DISTINCT ?a { ?b <by> ?a . ?b <pages> ?p } ORDER BY DESC(?p)") == [("x",)]
    assert ask("SELECT (COUNT(DISTINCT ?a) AS ?n) (MAX(strlen(?p)) AS ?m) { ?b <by> ?a . ?b <pages> ?p }") == [(1, 2)]
    assert sorted(ask("SELECT ?a { ?b <by> ?a }")) == [("x",), ("x",), ("y",)] and sorted(ask("SELECT REDUCED ?a { ?b <by> ?a }"))[0] == ("x",)


def test_filters_of_optional_patterns_see_outer_variables(books):
    q = parse_query("SELECT ?b ?t { ?b <by> ?a OPTIONAL { ?a <name> ?n } OPTIONAL { ?b <title> ?t FILTER (?t = ?n) } }")
    assert sorted(rows(q.to_df(books)), key=str) == [("b1", "Ann"), ("b2", None), ("b3", None)]


def test_distinct_results_don_t_go_through_products(books):
    q = parse_query("SELECT DISTINCT ?a { ?b <by> ?a . ?c <by> ?a . ?c <pages> ?p }")
    assert rows(q.to_df(books)) == [("x",)]
    assert sorted(rows(parse_query("SELECT ?a { ?b <by> ?a . ?c <by> ?a . ?c <pages> ?p }").to_df(books))) == [("x",)] * 4


def test_names_are_written_out(books):
    q = Query().namespace("q:", "").add(Triple(Var("b"), Ref("q:by"), Var("a"))).output(Var("a"))
    assert q.to_df(books).where(F.col("a") == "x").count() == 2
