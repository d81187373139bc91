import pytest

from lexispark.operators import graph
from lexispark.plans import questions
from lexispark.plans.sparql import Filter, Lit, Modifiers, Pattern, Query, Ref, Triple, Union, Var, call
from lexispark.streaming import models as streaming


@pytest.fixture
def triples(spark):
    rows = [("b1", "rdf:type", "ex:Book", None), ("b1", "label", "One", "en"), ("b1", "genre", "sf", None), ("b2", "rdf:type", "ex:Book", None), ("b2", "label", "Zwei", "de"), ("b3", "rdf:type", "ex:Book", None), ("b1", "by", "x", None), ("b2", "by", "x", None), ("b3", "by", "y", None)]
    return spark.createDataFrame(rows, "s string, p string, o string, o_lang string")


B, N, G, A = Var("b"), Var("n"), Var("g"), Var("a")


def test_optional_union_filter(triples):
    q = Query().add(Triple(B, Ref("rdf:type"), Ref("ex:Book")), Pattern().add(Triple(B, Ref("label"), N))).output(B, N)
    assert sorted(map(tuple, q.to_df(triples).collect()), key=str) == [("b1", "One"), ("b2", "Zwei"), ("b3", None)]
    q = Query().add(Triple(B, Ref("label"), N), Filter(call("langMatches", call("lang", N), Lit("EN")))).output(B)
    assert [r["b"] for r in q.to_df(triples).collect()] == ["b1"]
    q = Query().add(Union([Pattern().add(Triple(B, Ref("label"), N)), Pattern().add(Triple(B, Ref("genre"), G))])).output(B, N, G)
    assert q.to_df(triples).count() == 3


def test_group_having_order_limit(triples):
    q = Query().add(Triple(B, Ref("by"), A)).output(A).group(A).aggregate("COUNT", B, N)
    q.having = call(">", N, 1)
    assert [tuple(r) for r in q.to_df(triples).collect()] == [("x", 2)]
    q = Query().add(Triple(B, Ref("by"), A)).output(B)
    q.modifiers = Modifiers(order=[(B, True)], limit=1, offset=1)
    assert [r["b"] for r in q.to_df(triples).collect()] == ["b2"]
    assert q.to_sparql() == "SELECT ?b\nWHERE {\n  ?b <by> ?a .\n}\nORDER BY DESC(?b)\nLIMIT 1\nOFFSET 1"


def test_errors():
    with pytest.raises(TypeError):
        Triple(B, "p", N)
    with pytest.raises(TypeError):
        Pattern().add(3)
    with pytest.raises(ValueError):
        Modifiers(distinct=True, reduced=True)
    with pytest.raises(ValueError):
        Query().namespace("ex", "http://ex/")
    with pytest.raises(KeyError):
        Query().referent("no:thing")


def edges(spark, text):
    return spark.createDataFrame([tuple(x) for x in text.split()], "src string, dst string")


def values(df):
    return {r["v"] for r in df.collect()}


def test_graph_goldens(spark):
    e = edges(spark, "ab bc bd de df fg gb")
    assert [r["path"] for r in graph.paths(e, "a", "g").collect()] == [["a", "b", "d", "f", "g"]]
    assert values(graph.leaves(e)) == {"c", "e"} and values(graph.cyclic_vertices(e)) == {"b", "d", "f", "g"}
    e = edges(spark, "ab bc cd db ef")
    assert values(graph.roots(e)) == {"a", "e"} and graph.paths(e, "a", "e").isEmpty()
    assert graph.path_or_cycle({"a": ["b"], "b": ["c"], "c": ["d"], "d": ["b"], "e": ["f"]}, "a", "e") == ["b", "c", "d", "b"]
    empty = spark.createDataFrame([], "src string, dst string")
    assert graph.cyclic_vertices(empty).isEmpty() and graph.roots(empty).isEmpty()


def test_question_to_query_text(spark):
    q = questions.ask(spark, "/root/testdata/sf0.001", "What ECONOMY and PROMO parts has Supplier#000000003 supplied?")
    assert "UNION" in q.to_sparql() and q.to_sparql().startswith("SELECT DISTINCT ?part")
    assert questions.ask(spark, "/root/testdata/sf0.001", "How heavy is the moon?") is None


def test_streamed_counts_add_up(spark, tmp_path):
    names = spark.createDataFrame([("ab",), ("ab",), ("cd",)], "s string")
    names.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("s string").parquet(str(tmp_path / "in"))
    streaming.count_stream(stream, "s", 2, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r["gram"]: r["cnt"] for r in streaming.read_counts(spark, str(tmp_path / "out")).collect()}
    assert got["ab"] == 2 and sum(got.values()) == 9


def test_every_interpretation_is_kept(spark):
    """2,000 spans of one type: as many readings of a question, none left out, and the least information wins wherever it comes."""
    spans = [("type", 1, 1, float(2000 - k), "u") for k in range(2000)] + [("supplier", 4, 1, 0.0, "s")]
    scored = spark.createDataFrame([(1, "WHAT x PARTS HAS s SUPPLIED".split(), spans)], "id long, tokens array<string>, spans array<struct<kind:string,start:int,n:int,info:double,uri:string>>")
    found = questions.parse(scored)
    assert found.count() == 2000 and questions.best(found).first()["info"] == 1.0
