import math

from pyspark.sql import functions as F
import pytest

from lexispark.functions import text as X
from lexispark.operators import membership, models, similarity
from lexispark.queries import QUERIES


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(("name", "stand"), [("Tom Smith", "TOMSMITH"), ("Straße 1", "STRAE1"), ("", ""), (None, None), ("Éric", "RIC")])
def test_standardise(spark, name, stand):
    assert one(spark, name, X.standardise) == stand


def test_tokens_aliases_and_grams(spark):
    assert one(spark, " Is Will Smith, in? ", X.tokens) == ["IS", "WILL", "SMITH", ",", "IN"]
    assert one(spark, "George R Martin", X.aliases) == ["George R Martin", "George", "Martin"]
    assert one(spark, "Cher", X.aliases) == ["Cher"]
    assert one(spark, "ab", lambda c: X.ngrams(c, 3)) == ["\x02\x02a", "\x02ab", "ab\x03", "b\x03\x03"]


@pytest.mark.parametrize(("a", "b", "d"), [("tom smith", "john smith", 0.6471), ("tom smith", "tom", 0.7692), ("global kirstein investing", "kirstein global investing", 0.3125), ("global kirstein investing", "scherl global investing", 0.5946), ("kirstein global investing", "scherl global investing", 0.5143)])
def test_jaccard_golden_values(spark, a, b, d):
    names = spark.createDataFrame([(a,), (b,), (a,)], "s string")
    assert round(similarity.jaccard_pairs(names, "s").first()["d"], 4) == d


def test_info_jaccard_golden_values(spark):
    sample = spark.createDataFrame([(x,) for x in ("adam smith", "bob smith", "carl smith", "dale jones", "ernest kirstein")], "s string")
    pairs = spark.createDataFrame([("tom smith", "john smith"), ("tom smith", "tom"), ("john smith", "tom")], "a string, b string")
    got = {(r["a"], r["b"]): round(r["d"], 4) for r in similarity.info_jaccard(pairs, similarity.gram_model(sample, "s", 3)).collect()}
    assert got == {("tom smith", "john smith"): 0.7296, ("tom smith", "tom"): 0.7235, ("john smith", "tom"): 1.0}


def test_edits_find_transpositions_and_members(spark):
    words = spark.createDataFrame([("ABDC",), ("ABC",), ("XYZ",), (None,)], "w string")
    members = spark.createDataFrame([("ABCD",)], "m string")
    got = {r["w"]: r["found"] for r in membership.within_edits(words, "w", members, "m", 1, "ABCD").collect()}
    assert got == {"ABDC": True, "ABC": True, "XYZ": False, None: False}


def test_rating_threshold_and_deviation(spark):
    names = spark.createDataFrame([("aa",), ("aa",), ("ab",)], "s string")
    model, bounds = models.train_filter(names, "s", 2, 0.0)
    counts = {r["gram"]: r["cnt"] for r in model.collect()}
    assert sum(counts.values()) == 9 and counts["\x02a"] == 3
    low = bounds.first()["min_rating"]
    assert low == pytest.approx(((counts["\x02a"] + counts["ab"] + counts["b\x03"]) + 1) / (2 + 2 + 2) / 9)


def test_distribution_is_a_cumulative_histogram_and_cdf_is_monotone(spark):
    values = spark.createDataFrame([(float(v),) for v in (1, 2, 2, 4, 8)], "v double")
    dist = models.distribution(values, "v")
    assert [(r["bucket"], round(r["cum"], 6)) for r in dist.orderBy("bucket").collect()] == [(0, 0.2), (1, 0.6), (3, 0.8), (6, 1.0)]
    asked = spark.createDataFrame([(x / 4,) for x in range(0, 40)], "v double")
    p = [r["p"] for r in models.cdf(asked, "v", dist, "p").orderBy("v").collect()]
    assert p == sorted(p) and p[0] == 0 and p[-1] == 1
    same = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    assert models.cdf(same, "v", models.distribution(same, "v"), "p").first()["p"] == 1.0


def test_identify_and_near_ties(spark):
    entities = spark.createDataFrame([("DAVIDBLAINE", "u1"), ("JACKIECHAN", "u2"), ("DAVIDBLAIR", "u3")], "s string, u string")
    asked = spark.createDataFrame([("DAVIDBLANE",), ("QQQ",)], "q string")
    ranked = similarity.identify(asked, "q", entities, "s", "u")
    assert [r["u"] for r in ranked.orderBy("rank").collect()][0] == "u1"
    assert ranked.where("q = 'QQQ'").count() == 0
    assert similarity.near_ties(ranked, "q").where("rank = 1").count() == 1


def all_edits(word, letters):
    cuts = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    out = {a + b[1:] for a, b in cuts if b} | {a + b[1] + b[0] + b[2:] for a, b in cuts if len(b) > 1}
    return out | {a + c + b[1:] for a, b in cuts if b for c in letters} | {a + c + b for a, b in cuts for c in letters}


def test_edits_of_whole_words_over_their_own_alphabet(spark, tmp_path):
    spark.createDataFrame([("Big Z9", "Ax#1"), ("big z9", "Ax#7"), ("on", None), (None, "Ax#1")], "p_name string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    one = QUERIES["q_edits1"](spark, str(tmp_path)).where("s is not null").collect()
    assert sorted(map(tuple, one)) == sorted((w, e) for w in ("BIGZ9", "ON") for e in all_edits(w, "BIGZ9ON"))
    two = QUERIES["q_edits2"](spark, str(tmp_path)).where("word is not null").collect()
    assert sorted(map(tuple, two)) == sorted((w, f) for w in ("AX#1", "AX#7") for f in {f for e in all_edits(w, "AX#17") for f in all_edits(e, "AX#17")})


def test_identify_over_every_alias_of_every_part(spark, tmp_path):
    """A first word is found at distance 0, in each part that has it, by key; more parts of a name than are kept change nothing."""
    rows = [(9, "blue bolt"), (2, "blue bolt"), (5, "Blue ring"), (7, "navy blue"), (1, "red"), (4, "blue bolt"), (8, "blue bolt"), (3, None)]
    spark.createDataFrame(rows, "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    got = QUERIES["q_ident_topk"](spark, str(tmp_path))
    assert [tuple(r) for r in got.where("q = 'BLUE'").orderBy("rank").collect()] == [("BLUE", u, "BLUE", 0.0, k + 1) for k, u in enumerate((2, 4, 5, 7, 8))]
    assert [r["uri"] for r in got.where("q = 'BUEBOLT' and s = 'BLUEBOLT'").orderBy("rank").collect()] == [2, 4, 8, 9]
    assert QUERIES["q_ident_ambiguous"](spark, str(tmp_path)).where("q = 'BLUE'").count() == 5
    assert [tuple(r) for r in QUERIES["q_resolve_nodes"](spark, str(tmp_path)).where("asked in ('blue', 'rd')").orderBy("asked").collect()] == [("blue", 2, "BLUE"), ("rd", 1, "RED")]


def test_spans_are_not_broadcast_for_the_small_file_of_their_texts(spark, tmp_path):
    """60,000 spans of a text whose file is a few KB; they would pass the limit of what may be broadcast."""
    n = 10_000
    spark.createDataFrame([(1, 2, "user", "ab cd " * n), (1, 3, "user", None)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(1, "ab " * 60 + "cd " * 50 + "abcd " * 90 + "few " * 49)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1m")
    try:
        got = QUERIES["q_span_prob"](spark, str(tmp_path)).groupBy("id", "n", "span", "info", "rank", (F.col("start") % 2).alias("odd")).count().collect()
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    info = {w: round(-math.log(c / 200), 6) for w, c in (("AB", 60), ("CD", 50), ("ABCD", 90))}
    assert {tuple(r) for r in got} == {(1002, 2, "ABCD", info["ABCD"], 1, 0, n), (1002, 1, "AB", info["AB"], 2, 0, n), (1002, 1, "CD", info["CD"], 1, 1, n)}
