"""Near-duplicate documents by MinHash with tensored banding.

Two collections U and V of m half-keys each are drawn from one set of 2*m*r minimum hashes. Table (i, j) of the m*m banding
tables is keyed by the pair (u_i, v_j), so m*m tables of 2*r rows cost 2*m*r hashes instead of 2*m*m*r. A pair of texts
with similarity s meets in some table with probability (1 - (1 - s**r)**m)**2: with r = 3 and m = 12, over 0.9996 at 0.8.

The tables are never written out whole: half-keys u_i that only one set has are dropped first, and only the rest is
expanded by v_j. In two turns every set is compared with leaders of its buckets that are not yet in its component (first
the most central one, then a few drawn by hash), so a large group of copies costs a few comparisons for each copy. What is still apart in a shared
bucket is then compared exactly: only pairs that share one of their rarest shingles (a prefix of each set, ordered by
document frequency) can reach the similarity. Every link is confirmed on the full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispark.llm import textbytes as T
from lexispark.llm.common import checkpointed, fresh, own_columns, quoted
from lexispark.llm.components import components

#: Half-keys in a collection, and minimum hashes in a half-key.
HALF_KEYS, ROWS = 12, 3
_BLOCK = 4096
_EARLIER = 24
#: 64-bit words of a set's parity marks.
MARK_WORDS = 8
#: Leaders that a class is compared with in the second turn.
LEADERS = 8
SIGNATURE = "_id long, _h long, _n long, _key binary, _u array<long>, _v array<long>"


def _sets(texts: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each text's place and its sorted set of shingle hashes."""
    for chunk in T.chunks(texts):
        w = T.words(chunk, lower=True)
        shingles = T.windows(w.hashes, k)
        for i, (a, b) in enumerate(zip(w.first.tolist(), w.last.tolist(), strict=True)):
            if b - a >= k:
                yield chunk.first + i, np.unique(shingles[a : b - k + 1])
            elif b > a:
                yield chunk.first + i, T.windows(w.hashes[a:b], b - a)
            else:
                yield chunk.first + i, np.empty(0, np.uint64)


def _set_key(s: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    return T.mix(s).sum(dtype=np.uint64).tobytes() + (T.mix(s + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64).tobytes()


def _minima(shingles: np.ndarray, factors: np.ndarray, terms: np.ndarray) -> np.ndarray:
    out = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), _BLOCK):
        np.minimum(out, (factors[:, None] * shingles[None, i : i + _BLOCK] + terms[:, None]).min(axis=1), out=out)
    return out


def _signatures(k: int, half_keys: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 2 * half_keys * rows
        factors, terms = T.randoms(n, 21) | np.uint64(1), T.randoms(n, 22)
        mixers = T.randoms(rows, 23) | np.uint64(1)
        for batch in batches:
            counts, keys = np.zeros(len(batch), np.int64), [b""] * len(batch)
            halves = np.zeros((len(batch), 2 * half_keys), np.uint64)
            for i, s in _sets(batch.column(2), k):
                if len(s):
                    counts[i] = len(s)
                    keys[i] = _set_key(s)
                    halves[i] = T.mix((_minima(s, factors, terms).reshape(2 * half_keys, rows) * mixers).sum(axis=1, dtype=np.uint64))
            flat = halves.view(np.int64)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, (len(batch) + 1) * half_keys, half_keys), pa.int32()), pa.array(np.ascontiguousarray(x).ravel())) for x in (flat[:, :half_keys], flat[:, half_keys:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts), pa.array(keys, pa.binary()), *lists], ["_id", "_h", "_n", "_key", "_u", "_v"])

    return run


def _marks(s: np.ndarray) -> np.ndarray:
    """The parity marks of a set: bit i is how many of its shingles, modulo 2, are i modulo 64 * MARK_WORDS."""
    odd = np.bincount((s % np.uint64(64 * MARK_WORDS)).astype(np.int64), minlength=64 * MARK_WORDS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _full_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                sets = [s for _, s in _sets(batch.column(0).slice(at, 256), k)]
                cols = [pa.array([_set_key(s) for s in sets], pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array([_marks(s) for s in sets], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, ["_key", "_set", "_marks"])

    return run


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", half_keys: int = HALF_KEYS, rows: int = ROWS) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id (least id of all that links reach), kept.

    A text's set holds its distinct shingles of words, A-Z lower-cased; fewer words make one shingle of all. Texts link if
    100 * |intersection| >= percent * |union|. Null and empty texts, and texts of white space, have no shingles and no
    links. Equal sets are one class from the start. Rows that repeat an id keep a row each and share what their sets give. A null id takes
    part like any other and is never a component's id unless the component has no other. Other columns are left out.
    """
    sig, of_class = _classes(docs, shingle_words, percent, id_col, text_col, half_keys, rows)
    return (
        sig.select("_id", "_n", "_key")
        .join(of_class, "_key", "left")
        .select(F.col("_id").alias("doc_id"), F.col("_n").alias("n_shingles"), F.when(F.col("_n") > 0, F.col("_component")).otherwise(F.col("_id")).alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def deduplicated(docs: DataFrame, shingle_words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", half_keys: int = HALF_KEYS, rows: int = ROWS) -> DataFrame:
    """One row of each group of near duplicates, with the columns of docs as they are.

    The row with the least id stays (a null id comes last; of rows that share the id, the one whose text has the least hash; of rows that share
    id and text, any one). Rows are told apart by id and text, so a row that shares its id with a duplicate but not its text is not touched.
    Null and empty texts and texts of white space have no group and stay.
    """
    sig, of_class = _classes(docs, shingle_words, percent, id_col, text_col, half_keys, rows)
    each = sig.where("_n > 0").groupBy("_id", "_h", "_key").agg(F.count("*").alias("_many")).join(of_class.select("_key", "_label"), "_key")
    each = checkpointed(each.select("_id", "_h", "_many", "_label"), narrow=True)
    place = F.struct(F.col("_id").isNull().alias("z"), F.col("_id").alias("i"), F.col("_h").alias("h"))
    winners = checkpointed(each.groupBy("_label").agg(F.min(place).alias("_first")), narrow=True)
    found = each.join(winners, "_label").withColumn("_stays", place == F.col("_first"))
    row_id, row_h, stays = fresh(docs, "_id", "_h", "_stays")
    special = checkpointed(found.where("not _stays or _many > 1").select(F.col("_id").alias(row_id), F.col("_h").alias(row_h), F.col("_stays").alias(stays)), narrow=True)
    same = quoted(id_col).cast("long").eqNullSafe(F.col(row_id)) & (F.xxhash64(quoted(text_col).cast("string")) == F.col(row_h))
    alone = docs.join(special.select(row_id, row_h), same, "left_anti")
    again = special.where(F.col(stays))
    if again.isEmpty():
        return alone
    # repeated rows of one id and text: one of them, taken before rows travel
    (whole,) = fresh(docs, "_whole")
    one = docs.join(again, same).select(row_id, row_h, F.struct(*own_columns(docs)).alias(whole)).groupBy(row_id, row_h).agg(F.first(whole).alias(whole))
    return alone.unionByName(one.select(*[F.col(whole).getField(c).alias(c) for c in docs.columns]))


def _classes(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str, half_keys: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """The rows' signatures, and (_key, _label, _component) of every set that a row has: its component, and the least id there."""
    texts = docs.select(quoted(id_col).cast("long").alias("_id"), F.xxhash64(quoted(text_col).cast("string")).alias("_h"), quoted(text_col).cast("string").alias("_t"))
    sig = checkpointed(texts.mapInArrow(_signatures(k, half_keys, rows), SIGNATURE))
    grouped = sig.where("_n > 0").groupBy("_key").agg(F.min("_id").alias("_least"), F.first("_n").alias("_n"), F.first("_u").alias("_u"), F.first("_v").alias("_v"))
    # a class has a number from here on: shorter than its key, and as unique
    classes = checkpointed(grouped.withColumn("_c", F.monotonically_increasing_id()))
    buckets = checkpointed(_buckets(classes))
    links = _verified_links(docs, classes, buckets, k, percent, text_col, id_col)
    labels = components(links)
    named = classes.select("_key", "_c", "_least").join(labels.withColumnRenamed("node", "_c"), "_c", "left").withColumn("_label", F.coalesce("label", "_c"))
    least = named.groupBy("_label").agg(F.min("_least").alias("_component"))
    return sig, named.join(least, "_label").select("_key", "_label", "_component")


def _buckets(classes: DataFrame) -> DataFrame:
    """(bucket, _c, _n, _score) of the banding tables' buckets that at least two classes share; _score: how central a class is, the sizes of its buckets summed."""
    half = classes.select("_c", "_n", F.posexplode("_u").alias("_i", "_x"))
    shared = half.groupBy("_i", "_x").agg(F.count("*").alias("_many")).where("_many > 1").select("_i", "_x")
    some = half.join(shared, ["_i", "_x"]).join(classes.select("_c", "_v"), "_c")
    full = some.select("_c", "_n", "_i", "_x", F.posexplode("_v").alias("_j", "_y")).select(F.xxhash64("_i", "_x", "_j", "_y").alias("bucket"), "_c", "_n")
    full = full.join(full.groupBy("bucket").agg(F.count("*").alias("_many")).where("_many > 1"), "bucket")
    return full.join(full.groupBy("_c").agg(F.sum("_many").alias("_score")), "_c").select("bucket", "_c", "_n", "_score")


def _fits(percent: int, a: str, b: str) -> Column:
    """Sizes so far apart can't link."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _verified_links(docs: DataFrame, classes: DataFrame, buckets: DataFrame, k: int, percent: int, text_col: str, id_col: str) -> DataFrame:
    """Links (a, b) between classes that are enough for the components: every pair that shares a bucket is confirmed, refuted, or joined by other links."""
    some = classes.select("_c", "_key", "_least").join(buckets.select("_c").distinct(), "_c", "left_semi")
    texts = docs.select(quoted(id_col).cast("long").alias("_id"), quoted(text_col).cast("string").alias("_t")).join(some.select("_least").distinct(), F.col("_id").eqNullSafe(F.col("_least")), "left_semi")
    sets = checkpointed(texts.select("_t").mapInArrow(_full_sets(k), "_key binary, _set array<long>, _marks array<long>").dropDuplicates(["_key"]).join(some, "_key").select("_c", "_set", "_marks"))
    links, labelled = None, buckets.withColumn("_label", F.col("_c"))
    for turn in range(3):
        pairs = _possible(_leader_pairs(labelled, percent, turn), sets, percent) if turn < 2 else _prefix_pairs(labelled, sets, percent)
        found = checkpointed(_confirmed(pairs, sets, percent).where("_linked").select("a", "b"), narrow=True)
        links = found if links is None else links.union(found)
        if turn < 2:
            labels = components(links)
            labelled = checkpointed(_open_buckets(buckets.join(labels.withColumnRenamed("node", "_c"), "_c", "left").withColumn("_label", F.coalesce("label", "_c")).drop("label")))
    return links


def _open_buckets(labelled: DataFrame) -> DataFrame:
    """Buckets with more than one component."""
    still = labelled.groupBy("bucket").agg(F.min("_label").alias("_p"), F.max("_label").alias("_q")).where("_p <> _q").select("bucket")
    return labelled.join(still, "bucket")


def _leader_pairs(labelled: DataFrame, percent: int, turn: int) -> DataFrame:
    """Each class with leaders of its buckets that are in another component: in the first turn one, the most central, then up to LEADERS of them.

    A bucket's leader is its most central member in the first turn and one drawn by hash in the second.
    """
    rank = F.col("_score") if turn == 0 else F.xxhash64("_c", "bucket")
    leaders = labelled.groupBy("bucket").agg(F.max(F.struct(rank.alias("r"), "_c", "_n", "_label", "_score")).alias("_lead"))
    near = labelled.join(leaders, "bucket").where((F.col("_label") != F.col("_lead._label")) & _fits(percent, "_n", "_lead._n"))
    if turn == 0:
        one = near.groupBy("_c").agg(F.max(F.struct("_lead._score", F.col("_lead._c").alias("_c"))).alias("_best"))
        pairs = one.select("_c", F.col("_best._c").alias("_o"))
    else:
        # a class is in no more buckets than there are tables, so the set is small
        some = near.groupBy("_c").agg(F.slice(F.array_sort(F.collect_set(F.struct(F.xxhash64("_c", "_lead._c").alias("h"), F.col("_lead._c").alias("_o")))), 1, LEADERS).alias("_some"))
        pairs = some.select("_c", F.explode("_some._o").alias("_o"))
    return pairs.select(F.greatest("_c", "_o").alias("a"), F.least("_c", "_o").alias("b")).distinct()


def _possible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs without those that the sizes and marks of their sets refute, so that fewer sets travel."""
    marked = [sets.select(F.col("_c").alias(x), F.size("_set").alias(f"_n{x}"), F.col("_marks").alias(f"_m{x}")) for x in "ab"]
    differ = F.aggregate(F.zip_with("_ma", "_mb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    both = F.col("_na") + F.col("_nb")
    return pairs.join(marked[0], "a").join(marked[1], "b").where(differ <= both - 2 * F.ceil(both * percent / (100 + percent))).select("a", "b")


def _prefix_pairs(labelled: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """What is left: pairs of classes in different components that could still reach the similarity, by bounds that lose none.

    Only shingles that two components have can be common; a class needs enough of them (counted again once classes without
    are gone). Sets are ordered with the rarest of these shingles first. Two sets of n and k that link share at least
    percent * (n + k) / (100 + percent) shingles, so the smaller's first few and the larger's first few meet, and at each shingle
    where they meet what came before and what can follow bounds the overlap. A pair comes up where it first meets: a shingle is
    passed over if one of the few just before it is common too. Within a shingle the largest component's
    members are never paired with each other, so a large group meets only what is outside it.

    Every set has parity marks: each of its shingles flips one of 64 * MARK_WORDS bits. Marks of two sets differ in no more bits than the sets
    in shingles, so a pair whose marks differ in more than it can afford is refuted before it comes up; what comes up is close to what links.
    """
    members = labelled.select(F.col("_c").alias("_id"), F.col("_n").cast("int").alias("_n"), F.col("_label").alias("_l")).distinct()
    every = members.join(sets, F.col("_id") == F.col("_c")).select("_id", "_n", "_l", F.explode("_set").alias("_token"))
    needed = F.ceil(F.col("_n") * percent / 100)
    own = Window.partitionBy("_id")
    for _ in range(2):
        # checkpointed, so that the join that follows reads two plain exchanges, which adaptive execution can split at a hot shingle
        shared = checkpointed(every.groupBy("_token").agg(F.count("*").alias("_c"), F.min("_l").alias("_p"), F.max("_l").alias("_q")).where("_p <> _q").select("_token", "_c"), narrow=True)
        every = checkpointed(every.select("_id", "_n", "_l", "_token").join(shared, "_token").withColumn("_m", F.count("*").over(own)).where(F.col("_m") >= needed))
    rarest = own.orderBy("_c", "_token")
    ranked = every.withColumn("_at", F.row_number().over(rarest)).withColumn("_before", F.collect_list("_token").over(rarest.rowsBetween(-_EARLIER, -1)))
    marks = [f"_b{i}" for i in range(MARK_WORDS)]
    posts = ranked.where(F.col("_at") <= F.col("_m") - needed + 1).select("_token", "_id", "_n", "_l", "_m", "_at", "_before")
    posts = checkpointed(posts.join(sets.select(F.col("_c").alias("_id"), *[F.get("_marks", F.lit(i)).alias(m) for i, m in enumerate(marks)]), "_id"))
    of_label = posts.groupBy("_token", "_l").agg(F.count("*").alias("_c"))
    largest = of_label.groupBy("_token").agg(F.max(F.struct("_c", "_l")).alias("_top"), F.count("*").alias("_labels")).where("_labels > 1").select("_token", F.col("_top._l").alias("_top"))
    posts = checkpointed(posts.join(checkpointed(largest, narrow=True), "_token"))
    outside = posts.where("_l <> _top").select("_token", *[F.col(c).alias(f"{c}2") for c in ("_id", "_n", "_l", "_m", "_at", "_before", *marks)])
    overlap = F.ceil((F.col("_n") + F.col("_n2")) * percent / (100 + percent))
    can = F.least("_at", "_at2") + F.least(F.col("_m") - F.col("_at"), F.col("_m2") - F.col("_at2")) >= overlap
    short = F.when(F.col("_n") < F.col("_n2"), F.col("_at") <= F.col("_m") - F.ceil(F.col("_n") * 2 * percent / (100 + percent)) + 1).when(F.col("_n") > F.col("_n2"), F.col("_at2") <= F.col("_m2") - F.ceil(F.col("_n2") * 2 * percent / (100 + percent)) + 1).otherwise(True)
    differ = sum((F.bit_count(F.col(m).bitwiseXOR(F.col(f"{m}2"))) for m in marks), F.lit(0)) <= F.col("_n") + F.col("_n2") - 2 * overlap
    met = outside.join(posts, "_token").where((F.col("_l") != F.col("_l2")) & _fits(percent, "_n", "_n2") & can & short & differ & ~F.arrays_overlap("_before", "_before2"))
    return met.select(F.greatest("_id", "_id2").alias("a"), F.least("_id", "_id2").alias("b")).distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, _linked), by the full sets."""
    both = pairs.join(sets.select(F.col("_c").alias("a"), F.col("_set").alias("_s")), "a").join(sets.select(F.col("_c").alias("b"), F.col("_set").alias("_t")), "b")
    common = F.size(F.array_intersect("_s", "_t"))
    return both.select("a", "b", (common * 100 >= (F.size("_s") + F.size("_t") - common) * percent).alias("_linked"))
