"""Membership in sets of names, exact or within edits, and spans of tokens that are members."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.functions.text import ALPHABET, edits1
from lexispark.operators.filters import BloomSet


def within_edits(words: DataFrame, word: str, members: DataFrame | BloomSet, member: str = "", edits: int = 1, alphabet: str = ALPHABET) -> DataFrame:
    """words with `found`: whether the word, or a word at most `edits` edits away, is a member.

    Candidates meet the members in an equi-join. With a Bloom filter for members the join is with its blocks, and a word is found now and then
    that has no member near.
    """
    near = words.select(word).distinct().withColumn("_c", F.col(word))
    for _ in range(edits):
        near = near.union(near.select(word, F.explode(edits1(F.col("_c"), alphabet)))).distinct()
    hit = members.may_contain(near, "_c") if isinstance(members, BloomSet) else near.join(members.select(F.col(member).alias("_c")).distinct(), "_c", "left_semi")
    hit = hit.select(F.col(word).alias("_w")).distinct()
    return words.join(hit, words[word] == hit["_w"], "left").withColumn("found", F.col("_w").isNotNull()).drop("_w")


def flags(items: DataFrame, item: str, sets: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """items with a boolean column for each named set, and `in_any`."""
    out = items
    for name, (members, member) in sets.items():
        own = members.select(F.col(member).alias("_m")).distinct()
        out = out.join(own, out[item] == own["_m"], "left").withColumn(name, F.col("_m").isNotNull()).drop("_m")
    any_of = None
    for name in sets:
        any_of = F.col(name) if any_of is None else any_of | F.col(name)
    return out.withColumn("in_any", any_of)


def spans(rows: DataFrame, key: str, tokens: str, most_words: int = 3) -> DataFrame:
    """(key, start, n, span): the runs of 1 to most_words tokens, joined without a space."""
    # a start carries the few tokens after it, not the whole text's
    size = F.size(tokens)
    ahead = F.transform(F.filter(F.sequence(F.lit(0), size), lambda i: i < size), lambda i: F.slice(tokens, i + 1, F.lit(most_words)))
    at = rows.select(key, F.posexplode(ahead).alias("start", "_few"))
    each = at.select(key, "start", "_few", F.explode(F.sequence(F.lit(1), F.size("_few"))).alias("n"))
    return each.select(key, "start", "n", F.array_join(F.slice("_few", F.lit(1), F.col("n")), "").alias("span"))


def training_sample(items: DataFrame, item: str, n: int = 300) -> DataFrame:
    """(item): n distinct items, the first in the order of a hash, so that every run takes the same."""
    return items.select(item).where(F.col(item).isNotNull()).distinct().orderBy(F.md5(F.col(item).cast("string")), item).limit(n)


def span_members(found: DataFrame, members: DataFrame, member: str) -> DataFrame:
    """Spans that are members, shortest first at each start."""
    own = members.select(F.col(member).alias("span")).distinct()
    return found.join(own, "span", "left_semi").select(*found.columns)


def hyponym_lemmas(hyponyms: DataFrame, lemmas: DataFrame, synset: str) -> DataFrame:
    """(lemma): of the synset and all that hyponyms (parent, child) lead to. lemmas has (synset, lemma)."""
    from lexispark.operators.graph import reachable

    start = hyponyms.sparkSession.createDataFrame([(synset,)], "v string")
    reached = reachable(hyponyms.select(F.col("parent").alias("src"), F.col("child").alias("dst")), start)
    return lemmas.join(reached.withColumnRenamed("v", "synset"), "synset", "left_semi").select("lemma").distinct()
