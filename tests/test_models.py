import sys
from collections import Counter

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lexispark.demo import books
from lexispark.functions import text as X
from lexispark.operators import filters, graph, membership, models, order, similarity, store
from lexispark.plans import entities, generator
from lexispark.plans.grammar import Grammar, Word, rules
from lexispark.plans.sparql import Query, Ref, Triple, Var

NAMES = ["aa", "aa", "ab", "abc", "bcd", "xyz"]


def made(spark, values, name="s"):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def grams(s, n):
    t = "\x02" * (n - 1) + s + "\x03" * (n - 1)
    return [t[i : i + n] for i in range(len(t) - n + 1)]


def ratings(train, items, n):
    c = Counter(g for s in train for g in grams(s, n))
    return {s: (sum(c[g] for g in grams(s, n)) + 1) / (len(s) + n + 2) / sum(c.values()) for s in items}


def test_gram_filter_adds_updates_and_is_kept(spark, tmp_path):
    own = filters.GramFilter.train(made(spark, NAMES), "s", 2, 0.2)
    low = sorted(ratings(NAMES, NAMES, 2)[s] for s in NAMES)[1]
    assert own.bounds.first()["min_rating"] == pytest.approx(low) and own.bounds.first()["n"] == 6
    more = own.add(made(spark, ["abab", "zz"]), "s")
    assert more.bounds.first()["min_rating"] == pytest.approx(low)
    r = ratings([*NAMES, "abab", "zz"], [*NAMES, "zz"], 2)
    updated = more.updated()
    assert updated.bounds.first()["min_rating"] == pytest.approx(sorted(r[s] for s in NAMES)[1])
    updated.save(str(tmp_path / "f"))
    back = filters.GramFilter.load(spark, str(tmp_path / "f"))
    got = {x["s"]: x["member"] for x in back.contains(made(spark, [*NAMES, "zz", "qqqq"]), "s").collect()}
    bound = sorted(r[s] for s in NAMES)[1]
    assert got == {**{s: r[s] >= bound for s in {*NAMES, "zz"}}, "qqqq": False} and (back.n, back.fnr) == (2, 0.2)
    bare = back.allowed(0.5).cleaned()
    bare.save(str(tmp_path / "f2"))
    again = filters.GramFilter.load(spark, str(tmp_path / "f2"))
    assert again.training is None and again.bounds.first()["min_rating"] == pytest.approx(bound / 2)
    with pytest.raises(ValueError, match="cleaned"):
        again.updated()


def test_cluster_filter(spark, tmp_path):
    members = [("p", "aaa"), ("p", "aab"), ("q", "xyz"), ("q", "xyy")]
    own = filters.ClusterFilter.train(spark.createDataFrame(members, "c string, s string"), "c", "s", 2)
    low = {c: min(ratings([s for d, s in members if d == c], [s for d, s in members if d == c], 2).values()) for c in "pq"}
    assert {r["cluster"]: r["min_rating"] for r in own.bounds.collect()} == pytest.approx(low)
    assert {r["cluster"]: (r["n"], r["first"]) for r in own.stats().collect()} == {"p": (2, "aaa"), "q": (2, "xyy")}
    got = {r["s"]: r["member"] for r in own.contains(made(spark, ["aaa", "xyz", "mmm"]), "s").collect()}
    assert got == {"aaa": True, "xyz": True, "mmm": False}
    more = own.add(made(spark, ["aaaa", "aaaa", "mmm"]), "s")
    size = lambda f: {r["cluster"]: r["n"] for r in f.model.groupBy("cluster").agg(F.sum("cnt").alias("n")).collect()}
    assert size(own) == {"p": 8, "q": 8} and size(more) == {"p": 18, "q": 8}
    stretched = own.stretched(made(spark, ["ab"]), "s", 0.1)
    assert {r["s"]: r["member"] for r in stretched.contains(made(spark, ["ab"]), "s").collect()} == {"ab": True}
    more.updated().save(str(tmp_path / "c"))
    back = filters.ClusterFilter.load(spark, str(tmp_path / "c"))
    assert size(back) == size(more) and back.cleaned().stats().where("first is not null").isEmpty()


def test_bloom_set(spark, tmp_path):
    own = filters.BloomSet.build(spark.range(3000).select(F.col("id").cast("string").alias("w")), "w")
    own.save(str(tmp_path / "b"))
    own = filters.BloomSet.load(spark, str(tmp_path / "b"))
    asked = spark.range(9000).select(F.col("id").cast("string").alias("w"))
    found = own.may_contain(asked, "w")
    assert found.where("cast(w as long) < 3000").count() == 3000 and found.count() < 3000 + 200
    words = made(spark, ["2999", "299x", "xxxxxxxx", None], "w")
    got = {r["w"]: r["found"] for r in membership.within_edits(words, "w", own, edits=1, alphabet="0123456789").collect()}
    assert got["2999"] and got["299x"] and not got[None]
    assert filters.BloomSet.build(asked.limit(0), "w").may_contain(asked, "w").isEmpty()


def test_order_over_ranges(spark):
    rows = [(float(i % 17), 1) for i in range(500)]
    counts = spark.createDataFrame(rows, "v double, n long").groupBy("v").agg(F.sum("n").alias("n"))
    ordered = sorted(v for v, _ in rows)
    for at in (0, 7, 250, 499):
        assert order.place(counts, "v", "n", at).first()["v"] == ordered[at]
    assert order.place(counts, "v", "n", 500).isEmpty() and order.place(counts.limit(0), "v", "n", 0).isEmpty()
    assert order.least_gap(spark.createDataFrame([(1.0,), (4.0,), (4.5,), (9.0,)], "v double").repartition(3), "v").first()["gap"] == 0.5
    assert order.least_gap(counts.select("v").limit(1), "v").first()["gap"] is None


@pytest.mark.parametrize("most", [0.0, 0.3, 0.6, 0.9])
def test_similar_pairs_are_those_of_the_whole_join(spark, most):
    names = made(spark, ["BLUEBOLT", "BLUEBOLD", "BLUBOLT", "REDRING", "REDRINGS", "RING", "AAAA", "AAAAA", "AAA", "", "Z", None, "RING"])
    every = {(r["a"], r["b"]): round(r["d"], 9) for r in similarity.jaccard_pairs(names, "s").where(f"d <= {most}").collect()}
    assert {(r["a"], r["b"]): round(r["d"], 9) for r in similarity.similar_pairs(names, "s", most).collect()} == every


def test_closest_names_are_those_of_the_whole_join(spark):
    names = [f"{a}{b}" for a in ("RED", "BLUE", "GREEN", "DARK") for b in ("BOLT", "RING", "PIPE", "GEAR", "BOLTS")]
    asked = made(spark, ["REDBOLD", "BLUPIPE", "GEAR", "QQQ", "DARKRING"], "q")
    entities_ = spark.createDataFrame([(n, f"u{i % 7}{i}") for i, n in enumerate(names)], "s string, u string")
    got = similarity.identify(asked, "q", entities_, "s", "u", keep=3)

    def distance(a, b):
        x, y = Counter(grams(a, 3)), Counter(grams(b, 3))
        return 1 - sum((x & y).values()) / sum((x | y).values())

    for q in ("REDBOLD", "BLUPIPE", "GEAR", "DARKRING"):
        want = sorted((round(distance(q, n), 9), f"u{i % 7}{i}") for i, n in enumerate(names))[:3]
        assert [(round(r["d"], 9), r["u"]) for r in got.where(F.col("q") == q).orderBy("rank").collect()] == want
    assert got.where("q = 'QQQ'").isEmpty()


def test_training_sample_is_the_same_each_time(spark):
    rows = made(spark, [f"n{i % 50}" for i in range(200)] + [None])
    one = [r["s"] for r in membership.training_sample(rows, "s", 20).collect()]
    assert len(set(one)) == 20 and one == [r["s"] for r in membership.training_sample(rows.repartition(7), "s", 20).collect()]


def edges(spark, text):
    return spark.createDataFrame([tuple(x) for x in text.split()], "src string, dst string")


def test_graphs(spark):
    e = edges(spark, "ab bc cd db ef")
    assert graph.size(e) == 6 and graph.added(e, edges(spark, "ab fa")).count() == 6
    assert {r["src"]: r["found"] for r in graph.has(edges(spark, "ab ba"), edges(spark, "ab bb")).collect()} == {"a": True, "b": False}
    assert graph.is_cyclic(e) and not graph.is_cyclic(edges(spark, "ab bc ac cd")) and not graph.is_cyclic(edges(spark, "ab").limit(0))


@pytest.mark.parametrize("text", ["ab bc ca cd de ed ef", "aa ab bc", "ab ba bc cd dc da", "ab ba cd dc bc", "ab bc cd", "ab bc ca ce ef fe fg gg hi"])
def test_cycles_by_brute_force(spark, text):
    pairs = {tuple(x) for x in text.split()}
    reach = set(pairs)
    while new := {(a, d) for a, b in reach for c, d in pairs if b == c} - reach:
        reach |= new
    want = {v: max(w for w in {x for p in pairs for x in p} if (v, w) in reach and (w, v) in reach) for v in {a for a, b in reach if a == b}}
    assert {r["v"]: r["cycle"] for r in graph.cycles(edges(spark, text)).collect()} == want


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(500, 501), (7, 7), (None, 3)], "a long, b long")
    nodes = spark.range(302).union(spark.createDataFrame([(500,), (501,), (900,)], "id long")).withColumnRenamed("id", "node")
    got = {r["node"]: r["label"] for r in graph.components(links, nodes).collect()}
    assert got == {**{i: 0 for i in range(301)}, 301: 301, 500: 500, 501: 500, 900: 900}


def test_tokenizers_by_name():
    assert X.tokenizer("SimpleTokenizer") is X.tokens
    with pytest.raises(KeyError, match="SimpleTokenizer"):
        X.tokenizer("Nothing")


SF = "/root/testdata/sf0.001"


def test_entity_type_is_built_once_and_cleaned(spark, tmp_path):
    asked = []

    class Counting(dict):
        def __contains__(self, name):
            asked.append(name)
            return True

        def __getitem__(self, name):
            return books.triples(spark, SF)

    config = books.config(str(tmp_path))["named_entity_types"][2]
    genre = entities.EntityType.from_config(config)
    genre.build(spark, Counting())
    genre.build(spark, Counting())
    assert asked == ["star"] and store.exists(spark, str(tmp_path / "genre" / "grams"))
    genre.build(spark, Counting(), rebuild=True)
    assert asked == ["star"] * 2
    p = {r["s"]: r["p"] for r in genre.probabilities(made(spark, ["ECONOMY", "PROMO", "ZZZZ"]), "s").collect()}
    assert p["ECONOMY"] > 0 and p["ZZZZ"] == 0
    found = genre.identify(made(spark, ["ECONOMI"], "q"), "q").first()
    assert (found["uri"], found["given"], found["rank"]) == ("http://ex/type/ECONOMY", "ECONOMY", 1)
    genre.clean(spark)
    assert not store.exists(spark, str(tmp_path / "genre" / "grams"))


def test_choosing_among_ties(spark):
    ties = spark.createDataFrame([("q", "u1", "One", 1), ("q", "u2", "Two", 2), ("r", "u3", "Three", 1)], "q string, uri string, given string, rank int")
    plain = lambda df: {r["q"]: r["uri"] for r in df.collect()}
    assert plain(entities.chosen(ties, "q")) == {"q": "u1", "r": "u3"} and plain(entities.chosen(ties, "q", "none")) == {"r": "u3"}
    seen = {}
    assert plain(entities.chosen(ties, "q", lambda q, c: seen.setdefault(q, c) and 1)) == {"q": "u2", "r": "u3"} and seen == {"q": [("One", "u1"), ("Two", "u2")]}
    assert plain(entities.chosen(ties, "q", lambda q, c: None)) == {"r": "u3"}
    with pytest.raises(ValueError, match="choose"):
        entities.chosen(ties, "q", "any")


#: What a question on an author's books of a genre says.
WANTED = """PREFIX dbpprop: <http://dbpedia.org/property/>
PREFIX dbp: <http://dbpedia.org/resource/>
PREFIX dbpowl: <http://dbpedia.org/ontology/>
PREFIX rdfs: <http://www.w3.org/2000/01/rdf-schema#>
PREFIX rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#>
SELECT DISTINCT ?book ?title ?genre
WHERE {
  ?book rdfs:label ?title ;
    dbpprop:genre ?genre ;
    dbpowl:author dbp:George_R._R._Martin ;
    dbpprop:genre dbp:Science_fiction .
  FILTER (langMatches(lang(?title), "EN"))
}
LIMIT 100"""


def test_books_question_as_a_query():
    from lexispark.plans.grammar import Spans

    factory = books.Books()
    g = factory.grammar(["author", "book", "genre"])
    spans = {"genre": Spans(((1, 2, 4.602974),)), "author": Spans(((5, 2, 0.488245),)), "book": Spans(())}
    tree = g.compiled().with_terminals(g.terminals | spans).parse_full("WHAT SCIENCE FICTION BOOKS HAS GEORGE MARTIN WRITTEN".split())
    assert round(tree.info, 6) == 5.091219 and [x.symbol for x in tree.leaves()] == ["WHAT", "genre", "BOOKS", "HAS", "author", "WROTE"]
    rules_ = [books.Setup(), books.BooksRequest(), books.GeneralBooks(), books.AuthorsRequest(), books.BookInfo()]
    named = {("genre", 1): ("", "", "http://dbpedia.org/resource/Science_fiction"), ("author", 5): ("", "", "http://dbpedia.org/resource/George_R._R._Martin")}
    assert generator.construct(tree, rules_, named).to_sparql() == WANTED
    assert generator.construct(generator.from_flat(tree.flat()), rules_, named).to_sparql() == WANTED
    with pytest.raises(generator.GenerationError):
        generator.construct(tree, rules_, {})
    assert len(g.rules) == 17


def test_rules_are_asked_in_the_order_of_the_walk():
    tree = Grammar(rules("S -> A B C; A -> a; B -> b; C -> c"), {x: Word(x) for x in "abc"}).compiled().parse_full(list("abc"))
    seen = []

    class Look(generator.ConstructionRule):
        def consume(self, node, query, context):
            seen.append(node.symbol)
            return node.symbol == "C"

    generator.construct(tree, [Look()])
    assert seen == ["S", "A", "a", "C", "B", "b"]


class Two(generator.GrammarFactory):
    def grammar(self, kinds):
        return Grammar(rules("S -> GO genre; S -> GO Other; Other -> genre"), {"GO": Word("GO")})


class Refuses(generator.ConstructionRule):
    """No query for the reading without Other."""

    def consume(self, node, query: Query, context):
        if node.symbol == "S" and not node.find("Other"):
            raise generator.GenerationError("no")
        if node.symbol == "genre":
            query.add(Triple(Var("x"), Ref("http://p"), Ref(context.uri(node)))).output(Var("x"))
        return False


def test_a_reading_without_a_query_gives_way_to_the_next(spark, tmp_path):
    config = books.config(str(tmp_path))
    config["named_entity_types"] = config["named_entity_types"][2:]
    config["sparql_generator"] = {"grammar_factory": {"module": __name__, "class": "Two"}, "construction_rules": [{"module": __name__, "class": "Refuses"}]}
    pipe = generator.Pipeline(spark, config, {"star": books.triples(spark, SF)}).build()
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    try:
        asked = spark.createDataFrame([(1, "go ECONOMY"), (2, "go"), (3, None)], "id long, text string")
        (row,) = pipe.interpreted(pipe.scored(asked)).collect()
        (text,) = pipe.texts(asked).collect()
    finally:
        cloudpickle.unregister_pickle_by_value(sys.modules[__name__])
    assert (row["id"], row["interp"]) == (1, 1) and "Other" in [x["symbol"] for x in row["tree"]]
    assert "<http://ex/type/ECONOMY>" in text["sparql"]
    pipe.clean()
    assert not store.exists(spark, str(tmp_path / "genre" / "grams"))
