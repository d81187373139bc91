"""Mixing sources to target weights by a low-discrepancy schedule.

Slot i of the schedule has the golden-ratio point frac(i / phi), in whole numbers of 2**-52 so that late slots are as exact as early ones, which is mapped through the sources' cumulative shares, so any
stretch of the schedule holds every source close to its share. Slots are ranked per source; the k-th slot of a source takes its
k-th block, and after the last block the first again. A source's blocks are equal in words (to within one) and are
cut from its documents in shuffled order.

Nothing gathers a source in one task: documents and slots are numbered within hash buckets or stretches, and offsets come from the sums before
them. Only the table of sources, and of these sums, is ordered as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispark.llm.common import checkpointed, fresh, n_words, own_columns, quoted, uniform

#: Weights of the sources in order, repeating, and how often a source may be repeated.
WEIGHTS, MOST_REPEATS = (5.0, 2.0, 1.0), 3
#: Words in a block; documents in a bucket; slots in a stretch; cells by which points find their source.
BLOCK, BUCKET, STRETCH, CELLS = 64, 1024, 4096, 4096
#: The golden ratio's fraction in 2**-52, rounded to an odd number, in two parts of 26 bits.
_PHI_HIGH, _PHI_LOW = divmod(2783377641436327, 1 << 26)
_HALF = (1 << 26) - 1


def targets(sizes: DataFrame) -> DataFrame:
    """(_source, source_size, target, _lo, _hi) from (_source, source_size): the mix's words, and each source's interval of the schedule.

    Weights go by the order of sources by code point, null last. Targets share all words by weight but stop at MOST_REPEATS times the source's
    size; the excess is shared again by weight until none is above: sources are filled in the order of cap / weight, and the first
    level that the next source does not reach holds for all that are left.
    """
    everything = Window.orderBy(F.col("_source").asc_nulls_last())
    index = F.pmod(F.row_number().over(everything) - 1, F.lit(len(WEIGHTS)))
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), index.cast("int") + 1)
    w = sizes.withColumn("_w", weight).withColumn("_cap", F.col("source_size").cast("double") * MOST_REPEATS)
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("_source").asc_nulls_last())
    before, total = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    w = w.withColumn("_level", (F.sum("source_size").over(total) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (F.sum("_w").over(total) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))))
    # the water level: of the first source, in this order, that does not reach its cap
    level = F.min(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.struct(F.col("_cap") / F.col("_w"), F.col("_level").alias("level")))).over(total)["level"]
    w = w.withColumn("target", F.least(F.col("_cap"), F.coalesce(level * F.col("_w"), F.col("_cap"))))
    share = Window.orderBy(F.col("_source").asc_nulls_last())
    w = w.withColumn("_hi", F.sum("target").over(share) / F.sum("target").over(total)).withColumn("_lo", F.coalesce(F.lag("_hi").over(share), F.lit(0.0)))
    return w.select("_source", "source_size", "target", "_lo", "_hi")


def _ranked(rows: DataFrame, by: list[str], stretch: str, order: list[Column]) -> DataFrame:
    """rows with _rank, from 0, within by: numbered within stretches, which are offset by those before."""
    sizes = rows.groupBy(*by, stretch).agg(F.count("*").alias("_c"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_c").over(Window.partitionBy(*by).orderBy(stretch).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    inside = rows.withColumn("_in", F.row_number().over(Window.partitionBy(*by, stretch).orderBy(*order)))
    return inside.join(before, [*by, stretch]).withColumn("_rank", F.col("_before") + F.col("_in") - 1).drop("_in", "_before")


def point(slot: Column) -> Column:
    """frac(slot * phi) for slots up to 2**52: a product modulo 2**52 from parts of 26 bits, none of which overflows a long."""
    a, b = F.shiftright(slot, 26).bitwiseAND(F.lit(_HALF)), slot.bitwiseAND(F.lit(_HALF))
    high = F.shiftleft((a * _PHI_LOW + b * _PHI_HIGH).bitwiseAND(F.lit(_HALF)), 26)
    return (high + b * _PHI_LOW).bitwiseAND(F.lit((1 << 52) - 1)).cast("double") / F.lit(float(1 << 52))


def schedule(spark, plan: DataFrame, blocks: int) -> DataFrame:
    """(_slot, _s, _rank): the slots of the schedule, the source each draws, and its rank among the source's slots."""
    slots = spark.range(blocks).select(F.col("id").alias("_slot"), point(F.col("id")).alias("_x"))
    slots = slots.withColumn("_cell", F.floor(F.col("_x") * CELLS))
    cells = plan.where("_hi > _lo").select("_s", "_lo", "_hi", F.explode(F.sequence(F.floor(F.col("_lo") * CELLS), F.least(F.floor(F.col("_hi") * CELLS), F.lit(CELLS - 1)))).alias("_cell"))
    drawn = slots.join(cells, "_cell").where("_x >= _lo and _x < _hi").select("_slot", "_s", F.floor(F.col("_slot") / STRETCH).alias("_stretch"))
    return _ranked(drawn, ["_s"], "_stretch", [F.col("_slot")]).select("_slot", "_s", "_rank")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = BLOCK) -> DataFrame:
    """One row for each row of docs: doc_id, size (words; null text: 0), source_size, target (of its source), taken (words that the mix takes of it, repeats counted),
    first_slot (the slot of the schedule that takes the first of them; null if none).

    A source takes its target's words, rounded; no row is taken beyond MOST_REPEATS times its size. Texts without words are
    never taken. A null source is a source, the last in order. Rows that repeat an id are taken one by one. Ids order the
    shuffle by hash, so runs agree; equal rows are interchangeable. Other columns are left out; no rows give no rows.
    """
    return _taken(docs, id_col, text_col, source_col, block_words).select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", "taken", "first_slot")


def _taken(docs: DataFrame, id_col: str, text_col: str, source_col: str, block_words: int = BLOCK) -> DataFrame:
    """What mix() returns, with the source (_source) and the text's hash (_h)."""
    spark = docs.sparkSession
    rows = docs.select(quoted(id_col).alias("doc_id"), quoted(source_col).alias("_source"), n_words(quoted(text_col)).alias("size"), F.md5(quoted(text_col).cast("string")).alias("_h"))
    rows = checkpointed(rows)
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n"), F.count("*").alias("rows")).first()
    plan = targets(rows.groupBy("_source").agg(F.sum("size").alias("source_size")))
    # a key that is never null, and blocks: how many there are, and how many slots the target needs
    key = F.coalesce(F.concat(F.lit("="), F.col("_source").cast("string")), F.lit(""))
    plan = plan.withColumn("_s", key).withColumn("_nb", F.greatest(F.lit(1), F.ceil(F.col("source_size") / block_words))).withColumn("_take", F.round("target").cast("long"))
    # a source's words in blocks: the first _more have one word more than the others; edge() is where a block begins, of() the block that a word is in
    plan = plan.withColumn("_each", _div(F.col("source_size"), F.col("_nb"))).withColumn("_more", F.col("source_size") % F.col("_nb"))
    edge = lambda j: j * F.col("_each") + F.least(j, F.col("_more"))
    of = lambda word: F.when(word < F.col("_more") * (F.col("_each") + 1), _div(word, F.col("_each") + 1)).otherwise(F.col("_more") + _div(word - F.col("_more") * (F.col("_each") + 1), F.col("_each")))
    rest = F.col("_take") % F.col("source_size")
    needs = _div(F.col("_take"), F.col("source_size")) * F.col("_nb") + F.when(rest > 0, of(rest - 1) + 1).otherwise(F.lit(0))
    plan = checkpointed(plan.withColumn("_slots", F.when(F.col("source_size") > 0, needs).otherwise(F.lit(0))), narrow=True)
    n_slots = max(1, total["n"] // block_words)
    slots = schedule(spark, plan, n_slots)
    drawn = slots.groupBy("_s").agg(F.count("*").alias("_drawn"))
    # rounding leaves a source a few slots above or below what its target needs: surplus slots are dropped, missing ones close the schedule
    closing = plan.join(drawn, "_s", "left").where(F.col("_slots") > F.coalesce("_drawn", F.lit(0))).select("_s", F.explode(F.expr("sequence(coalesce(_drawn, 0L), _slots - 1)")).alias("_rank"))
    own = plan.select("_s", "_nb", "_each", "_more", "_slots", "_take", "source_size")
    taken = slots.select("_s", "_rank", "_slot").union(closing.select("_s", "_rank", (F.col("_rank") + n_slots).alias("_slot"))).join(own, "_s").where("_rank < _slots")
    block = F.col("_rank") % F.col("_nb")
    begins = _div(F.col("_rank"), F.col("_nb")) * F.col("source_size") + edge(block)
    full = edge(block + 1) - edge(block)
    # the last slot of a source takes only what its target still needs
    taken = taken.select("_s", "_slot", block.alias("_block"), F.least(full, F.col("_take") - begins).alias("_words"), full.alias("_full"))
    whole = F.col("_words") == F.col("_full")
    per_block = taken.groupBy("_s", "_block").agg(F.sum(whole.cast("long")).alias("_whole"), F.sum(F.when(whole, F.lit(0)).otherwise(F.col("_words"))).alias("_part"), F.min("_slot").alias("_slot"))
    # each document's interval in its source's shuffled words
    buckets = max(1, total["rows"] // BUCKET)
    laid = rows.withColumn("_s", key).withColumn("_u", uniform("doc_id", "_h", salt="mix")).withColumn("_bucket", F.floor(F.col("_u") * buckets))
    sums = laid.groupBy("_s", "_bucket").agg(F.sum("size").alias("_c"))
    offsets = sums.withColumn("_before", F.coalesce(F.sum("_c").over(Window.partitionBy("_s").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    inside = Window.partitionBy("_s", "_bucket").orderBy("_u", "doc_id", "_h", "_row").rowsBetween(Window.unboundedPreceding, -1)
    laid = checkpointed(laid.withColumn("_row", F.monotonically_increasing_id()))
    placed = laid.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(offsets, ["_s", "_bucket"]).join(own.select("_s", "_each", "_more"), "_s").withColumn("_from", F.col("_before") + F.col("_in"))
    # the blocks that it overlaps
    pieces = placed.where("size > 0").select("_row", "_s", "_from", "size", "_each", "_more", F.explode(F.sequence(of(F.col("_from")), of(F.col("_from") + F.col("size") - 1))).alias("_block"))
    begin, end = F.greatest("_from", edge(F.col("_block"))), F.least(F.col("_from") + F.col("size"), edge(F.col("_block") + 1))
    part = F.greatest(F.lit(0), F.least(end, edge(F.col("_block")) + F.col("_part")) - begin)
    words = pieces.join(per_block, ["_s", "_block"]).withColumn("_got", F.col("_whole") * (end - begin) + part).groupBy("_row").agg(F.sum("_got").alias("taken"), F.min(F.when(F.col("_got") > 0, F.col("_slot"))).alias("first_slot"))
    named = plan.select("_s", "source_size", "target")
    return laid.join(words, "_row", "left").join(named, "_s").select("doc_id", "_source", "_h", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot")


def _div(a: Column, b: Column) -> Column:
    """Whole-number division."""
    return F.call_function("div", a, b)


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs as the mix takes them: a row for each time that a document is taken whole, and one with the first words for a part; columns stay as they are.

    Rows are told apart by id, source and text; a null id or source is equal to itself. Rows that agree in the three share what the mix takes of them: each
    is repeated as often, and what is left over comes with the other columns of one of them. Documents without words, or of which nothing is
    taken, are left out; n_chars, if there is such a column, is that of the text.
    """
    key = fresh(docs, "_mid", "_msource", "_mhash")
    size, times, words, share = fresh(docs, "_msize", "_mtimes", "_mwords", "_mshare")
    per = _taken(docs, id_col, text_col, source_col).where("size > 0").groupBy("doc_id", "_source", "_h").agg(F.first("size").alias(size), F.sum("taken").alias("_t"), F.count("*").alias("_many")).where("_t > 0")
    # whole takes of each row; the rest of the group: whole takes, and the words of a part
    per = per.withColumn("_whole", F.floor(F.col("_t") / F.col(size))).withColumn("_part", F.col("_t") % F.col(size))
    per = checkpointed(per.withColumnsRenamed(dict(zip(("doc_id", "_source", "_h"), key))))
    same = quoted(id_col).eqNullSafe(F.col(key[0])) & quoted(source_col).eqNullSafe(F.col(key[1])) & (F.md5(quoted(text_col).cast("string")) == F.col(key[2]))
    zero, nothing = F.lit(0).cast("long"), F.array().cast("array<bigint>")
    # copies of whole words: 0 stands for the whole text, a number for so many words
    single = F.concat(F.array_repeat(zero, F.col("_whole").cast("int")), F.when(F.col("_part") > 0, F.array("_part")).otherwise(nothing))
    copies = F.array_repeat(zero, F.floor(F.col("_whole") / F.col("_many")).cast("int"))
    given = per.select(*key, F.when(F.col("_many") == 1, single).otherwise(copies).alias(times)).where(F.size(times) > 0)
    out = docs.join(given, same).select(*own_columns(docs), F.explode(times).alias(words))
    rest = per.where("_many > 1 and (_whole % _many > 0 or _part > 0)")
    if not rest.isEmpty():
        (whole,) = fresh(docs, "_whole")
        one = docs.join(rest.select(*key), same).select(*key, F.struct(*own_columns(docs)).alias(whole)).groupBy(*key).agg(F.first(whole).alias(whole))
        # one narrow row for each copy; a group's copies meet its text in a join that can be split
        pieces = rest.select(*[F.col(k).alias(f"{k}2") for k in key], F.explode(F.concat(F.array_repeat(zero, (F.col("_whole") % F.col("_many")).cast("int")), F.when(F.col("_part") > 0, F.array("_part")).otherwise(nothing))).alias(share))
        met = pieces.join(checkpointed(one), F.col(key[0]).eqNullSafe(F.col(f"{key[0]}2")) & F.col(key[1]).eqNullSafe(F.col(f"{key[1]}2")) & (F.col(key[2]) == F.col(f"{key[2]}2")))
        out = out.unionByName(met.select(*[F.col(whole).getField(c).alias(c) for c in docs.columns], F.col(share).alias(words)))
    own = quoted(text_col)
    first = F.array_join(F.slice(F.filter(F.split(own, r"[\x20\x09-\x0D]+"), lambda w: w != ""), F.lit(1), F.greatest(F.lit(1), F.col(words)).cast("int")), " ")
    text = F.when(F.col(words) == 0, own).otherwise(first)
    n_chars = F.when(F.col(words) == 0, F.length(own)).otherwise(F.length(first))
    return out.select(*[text.alias(c) if c == text_col else n_chars.cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else quoted(c) for c in docs.columns])
