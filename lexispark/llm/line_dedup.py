"""Repeated runs of lines across documents, found by winnowing over line hashes.

A document is a sequence of its lines that have a word. Every GRAM consecutive line hashes make a gram; in each window of
WINDOW grams the gram with the least hash (the rightmost of equals) is a fingerprint, so any run of GRAM + WINDOW - 1 lines
that two places share has a fingerprint in common. Only fingerprints that occur twice are followed up: around each of their
positions the match is extended line by line both ways, as far as every stretch of `least` lines was seen earlier. A line of
`long_words` words or more is a run by itself, and its own fingerprint; so are two consecutive lines of that many words together.

Earlier means: in a document with a smaller id (null ids come last), or before it in the same one. The first occurrence stays; what later ones
repeat is deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispark.llm.common import WORD, checkpointed, few_files, fresh, own_columns, quoted

#: Lines in a gram, grams in a window; a shared run of GRAM + WINDOW - 1 = 3 lines is always found.
GRAM, WINDOW = 2, 2
LEAST, LONG_WORDS = GRAM + WINDOW - 1, 50


def _hash(*columns: Column) -> Column:
    return F.xxhash64(*columns)


def _words(line: Column) -> Column:
    return F.size(F.filter(F.split(line, r"[\x20\x09-\x0D]+"), lambda w: w != ""))


def repeated_lines(docs: DataFrame, long_words: int = LONG_WORDS, id_col: str = "doc_id", text_col: str = "text", two_lines: bool = True, narrow: bool = False) -> DataFrame:
    """(_id, _h, removed): for each document with a repeated run, the places of its lines to delete, from 0, ascending; _h is its text's hash.

    Rows that agree in id and text are one document; rows that share an id only are ordered by their text's hash.
    narrow: checkpoints go to few files, a core or 128 MB of docs each, not to one for each shuffle partition; tasks are larger then, so it is for executors without Python workers.
    """
    source = docs.select(quoted(id_col).cast("long").alias("_id"), F.xxhash64(quoted(text_col)).alias("_h"), quoted(text_col).alias("_t")).where(F.col("_t").isNotNull())
    lines = (
        source.select("_id", "_h", F.posexplode(F.split("_t", "\n", -1)).alias("_at", "_line"))
        .where(F.col("_line").rlike(WORD))
        .select("_id", "_h", "_at", F.xxhash64("_line", F.lit(1)).alias("_x"), _words(F.col("_line")).alias("_w"))
        .distinct()
    )
    own = Window.partitionBy("_id", "_h").orderBy("_at")
    # the stretch of LEAST lines that begins at each line, its grams, and the one that the window selects
    ahead = lines.select("*", F.row_number().over(own).alias("_n"), F.lead("_w").over(own).alias("_w1"), *[F.lead("_x", i).over(own).alias(f"_x{i}") for i in range(1, LEAST)])
    stretch = [F.col("_x"), *[F.col(f"_x{i}") for i in range(1, LEAST)]]
    whole = stretch[-1].isNotNull()
    # null at the last line
    pair = F.when(F.col("_w") + F.col("_w1") >= long_words, _hash(*stretch[:2], F.lit(2))) if two_lines else F.lit(None).cast("long")
    grams = [_hash(*stretch[i : i + GRAM]) for i in range(WINDOW)]
    ahead = ahead.select(
        "_id", "_h", "_at", "_n", "_x", (F.col("_w") >= long_words).alias("_long"), pair.alias("_pair"),
        F.when(whole, _hash(*stretch, F.lit(LEAST))).alias("_run"),
        F.when(whole, F.array_min(F.array(*[F.struct(g.alias("g"), F.lit(-i).alias("d")) for i, g in enumerate(grams)]))).alias("_pick"),
    )
    files = few_files(docs) if narrow else 0
    ahead = checkpointed(ahead, narrow, files)
    # fingerprints at their positions, once each, and those that occur at two places
    picked = ahead.where("_pick is not null").select("_id", "_h", (F.col("_n") - F.col("_pick.d")).alias("_n"), F.col("_pick.g").alias("_print"))
    alone = ahead.where("_long").select("_id", "_h", "_n", _hash("_x", F.lit(0)).alias("_print"))
    pairs = ahead.where("_pair is not null").select("_id", "_h", "_n", "_pair")
    prints = (picked.union(alone).union(pairs) if two_lines else picked.union(alone)).distinct()
    twice = prints.groupBy("_print").agg(F.count("*").alias("_c")).where("_c > 1").select("_print")
    seeds = prints.join(twice, "_print").select("_id", "_h", "_n").distinct()
    # extend: stretches that hold a seed, joined by document and line; of equal stretches all but the first are repeats
    starts = seeds.select("_id", "_h", F.explode(F.expr(f"sequence(_n - {LEAST - 1}, _n)")).alias("_n")).distinct()
    near = _at_places(ahead, starts)
    units = near.where("_run is not null").select("_id", "_h", "_n", F.col("_run").alias("_key"), F.lit(LEAST).alias("_size"))
    units = units.union(near.where("_long").select("_id", "_h", "_n", _hash("_x", F.lit(0)).alias("_key"), F.lit(1).alias("_size")))
    if two_lines:
        units = units.union(near.where("_pair is not null").select("_id", "_h", "_n", "_pair", F.lit(2)))
    place = F.struct(F.col("_id").isNull().alias("_z"), "_id", "_h", "_n")
    units = checkpointed(units, narrow, files)
    first = units.groupBy("_key", "_size").agg(F.min(place).alias("_first"), F.count("*").alias("_c")).where("_c > 1")
    # checkpointed, so that the join reads two plain exchanges, which adaptive execution can split at a frequent passage
    later = units.join(checkpointed(first, narrow, files), ["_key", "_size"]).where(~place.eqNullSafe(F.col("_first")))
    hit = later.select("_id", "_h", F.explode(F.expr("sequence(_n, _n + _size - 1)")).alias("_n")).distinct()
    return _at_places(ahead.select("_id", "_h", "_n", "_at"), hit).groupBy("_id", "_h").agg(F.sort_array(F.collect_list("_at")).alias("removed"))


def _at_places(lines: DataFrame, places: DataFrame) -> DataFrame:
    """The lines at the given places (_id, _h, _n); a null id is equal to itself."""
    at = places.select(F.col("_id").alias("_i2"), F.col("_h").alias("_h2"), F.col("_n").alias("_n2"))
    return lines.join(at, F.col("_id").eqNullSafe(F.col("_i2")) & (F.col("_h") == F.col("_h2")) & (F.col("_n") == F.col("_n2")), "left_semi")


def _kept_text(text: Column, removed: Column) -> Column:
    """The text without the lines at the places in removed: slices of lines between them, in one pass."""
    lines = F.split(text, "\n", -1)
    edges = F.concat(F.array(F.lit(-1)), removed, F.array(F.size(lines)))
    gaps = F.filter(F.zip_with(F.slice(edges, F.lit(1), F.size(edges) - 1), F.slice(edges, F.lit(2), F.size(edges) - 1), lambda a, b: F.struct((a + 2).alias("from"), (b - a - 1).alias("n"))), lambda g: g["n"] > 0)
    return F.array_join(F.flatten(F.transform(gaps, lambda g: F.slice(lines, g["from"], g["n"]))), "\n")


def dedup_lines(docs: DataFrame, long_words: int = LONG_WORDS, id_col: str = "doc_id", text_col: str = "text", two_lines: bool = True, n_lines: str = "n_lines", n_removed: str = "n_removed", narrow: bool = False) -> DataFrame:
    """docs with repeated runs of lines deleted from the text, and n_lines and n_removed (of lines) added; columns of those names are replaced.

    Deleted: every line of a run of at least 3 lines with a word each that occurs earlier, lines without a word not counted, every line
    of at least long_words words that occurs earlier, and, with two_lines, both lines of two consecutive ones of at least long_words words together
    that occur earlier. Lines without a word are never deleted. No row goes: a text that repeats others becomes empty. Null stays null (0 lines), an empty text has one line and stays. Rows that repeat an id
    and its text get the same result; rows that repeat an id only, and rows with a null id, are documents of their own, told apart by their texts. narrow: as in repeated_lines.
    """
    row_id, row_h, places = fresh(docs, "_rid", "_rh", "_removed")
    found = repeated_lines(docs, long_words, id_col, text_col, two_lines, narrow).withColumnsRenamed({"_id": row_id, "_h": row_h, "removed": places})
    joined = docs.select(*own_columns(docs, [n_lines, n_removed])).join(found, quoted(id_col).cast("long").eqNullSafe(F.col(row_id)) & (F.xxhash64(quoted(text_col)) == F.col(row_h)), "left")
    gone, own = F.col(places), quoted(text_col)
    text = F.when(gone.isNull(), own).otherwise(_kept_text(own, gone))
    return joined.select(
        *[(text.alias(c) if c == text_col else quoted(c)) for c in docs.columns if c.lower() not in (n_lines.lower(), n_removed.lower())],
        F.when(own.isNull(), F.lit(0)).otherwise(F.size(F.split(own, "\n", -1))).cast("long").alias(n_lines),
        F.when(gone.isNull(), F.lit(0)).otherwise(F.size(gone)).cast("long").alias(n_removed),
    )


#: For documents whose ids are unique; long_words is 50, with two_lines.
ORACLE = r"""
with l0 as (select doc_id, text, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as at_ from documents where text is not null),
l as (select doc_id, line, at_, row_number() over (partition by doc_id order by at_) as n,
      len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda w: w <> '')) as words
      from l0 where regexp_matches(line, '[^\x20\x09-\x0D]')),
r as (select doc_id, n, at_, words, line, lead(line, 1) over w as l1, lead(line, 2) over w as l2, lead(words, 1) over w as words1 from l window w as (partition by doc_id order by n)),
runs as (select doc_id, n, 3 as size, md5(line || chr(10) || l1 || chr(10) || l2) as k from r where l2 is not null
         union all select doc_id, n, 1, md5(line) from r where words >= 50
         union all select doc_id, n, 2, md5(line || chr(10) || l1) from r where l1 is not null and words + words1 >= 50),
f as (select doc_id, n, size, row_number() over (partition by size, k order by doc_id, n) as seen from runs),
hit as (select distinct doc_id, unnest(range(n, n + size)) as n from f where seen > 1),
gone as (select r.doc_id, r.at_ from r join hit using (doc_id, n)),
c as (select doc_id, count(*) as n_removed from gone group by 1),
t as (select l0.doc_id, string_agg(line, chr(10) order by l0.at_) as text from l0 left join gone using (doc_id, at_) where gone.at_ is null group by 1)
select d.doc_id, case when d.text is null then null else coalesce(t.text, '') end as text,
       cast(coalesce(len(string_split(d.text, chr(10))), 0) as bigint) as n_lines, cast(coalesce(n_removed, 0) as bigint) as n_removed
from documents d left join t using (doc_id) left join c using (doc_id)
"""
