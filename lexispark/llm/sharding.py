"""Sharding by a hierarchical weighted hash tree.

A row descends region, rack and shard levels. At each level every child of the chosen node draws -ln(u) / weight, u being
a hash of the row's key and the child's name, and the least draw wins, so a child gets rows in proportion to its weight.
The draws of a node's children depend on nothing outside the node: a changed weight moves rows within the subtrees whose
weights change and nowhere else.

A shard that is added later is an increment: at the root it draws once, with its own weight, against the region that
won. A row for which it wins goes straight to it and all others descend as before, so an added shard takes rows only into
itself, and the subtree above it still gains exactly its weight.

Everything is a Column expression: no shuffle is needed to place a row, and each level hashes only the children of the node that was chosen.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispark.llm.common import checkpointed, fresh, own_columns, quoted, uniform


@dataclass(frozen=True)
class Rack:
    weights: tuple[float, ...]


@dataclass(frozen=True)
class HashTree:
    """Regions of racks of shards, numbered from 0 in order; added: weights of shards that came later, numbered on."""

    regions: tuple[tuple[Rack, ...], ...]
    added: tuple[float, ...] = field(default=())

    def __post_init__(self) -> None:
        weights = [w for racks in self.regions for r in racks for w in r.weights] + list(self.added)
        if not weights or any(w <= 0 for w in weights):
            raise ValueError("every shard needs a weight above 0, and there must be a shard")

    @property
    def n_shards(self) -> int:
        return sum(len(r.weights) for racks in self.regions for r in racks) + len(self.added)


def even_tree(regions: int, racks: int, shards: int) -> HashTree:
    return HashTree(tuple(tuple(Rack((1.0,) * shards) for _ in range(racks)) for _ in range(regions)))


def _draw(key: str, name: Column, weight: Column) -> Column:
    return F.when(weight > 0, -F.log(uniform(key, name)) / weight).otherwise(F.lit(float("inf")))


def _least(key: str, level: str, parent: Column | None, weights: list[list[float]], row: Column | None) -> Column:
    """(d, v) of the child with the least draw: weights[row] are the children's, of the node named by parent."""
    most = max(map(len, weights))
    table = F.array(*[F.array(*[F.lit(float(x)) for x in (*w, *[0.0] * (most - len(w)))]) for w in weights])
    own = F.get(table, F.lit(0) if row is None else row)
    prefix = F.lit(f"{level} ") if parent is None else F.concat(F.lit(f"{level} "), parent, F.lit("."))
    return F.array_min(F.transform(own, lambda w, k: F.struct(_draw(key, F.concat(prefix, k.cast("string")), w).alias("d"), k.alias("v"))))


def place(rows: DataFrame, tree: HashTree, key: str, to: str = "shard", grown: str | None = None, weight: float = 1.0) -> DataFrame:
    """rows with the shard of the column key, and with the one that it would have if a shard of the given weight were added. A null key is a key like any other."""
    racks = [[sum(r.weights) for r in region] for region in tree.regions]
    flat = [list(r.weights) for region in tree.regions for r in region]
    first_rack, first_shard, n_racks, n = [], [], 0, 0
    for region in tree.regions:
        first_rack.append(n_racks)
        n_racks += len(region)
    for weights in flat:
        first_shard.append(n)
        n += len(weights)
    lookup = lambda values, at: F.get(F.array(*[F.lit(v) for v in values]), at)
    rows = rows.withColumn("_region", _least(key, "region", None, [[sum(w) for w in racks]], None))
    rows = rows.withColumn("_rack", _least(key, "rack", F.col("_region.v").cast("string"), racks, F.col("_region.v"))["v"])
    rows = rows.withColumn("_flat", lookup(first_rack, F.col("_region.v")) + F.col("_rack"))
    rows = rows.withColumn("_shard", lookup(first_shard, F.col("_flat")) + _least(key, "shard", F.concat_ws(".", "_region.v", "_rack"), flat, F.col("_flat"))["v"])
    later = list(tree.added)
    base = F.struct(F.col("_region.d").alias("d"), F.col("_shard").alias("v"))
    draws = [F.struct(_draw(key, F.lit(f"added {i}"), F.lit(w)).alias("d"), F.lit(n + i).alias("v")) for i, w in enumerate([*later, weight])]
    rows = rows.withColumn(to, (F.array_min(F.array(base, *draws[:-1])) if later else base)["v"])
    if grown:
        rows = rows.withColumn(grown, F.array_min(F.array(base, *draws))["v"])
    return rows.drop("_region", "_rack", "_flat", "_shard")


def assign(docs: DataFrame, tree: HashTree, id_col: str = "doc_id", text_col: str = "text", block_rows: int = 100_000) -> DataFrame:
    """Every row of docs with its shard under tree and under tree with one more shard.

    Columns: doc_id, size (UTF-8 bytes of the text plus 16), text_crc32 (of the text's UTF-8 bytes, unsigned), law (`key`: only the
    id and the tree decide), shard, slot (gapless from 0 in each shard), grown_shard. A null text has no bytes; a null id
    is placed like any other; rows that repeat an id share its shard and have slots of their own, which among equal rows are
    interchangeable. Other columns are left out; no rows give no rows.

    Slots need no task to hold a shard: rows are numbered within blocks of about block_rows rows that a hash of the id makes, and
    blocks are offset by the sizes of those before. The number of blocks follows the number of rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.col(id_col)
    rows = docs.select(key.alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    # narrow, and read twice: for the blocks' sizes and for the slots
    rows = checkpointed(place(rows, tree, "doc_id", "shard", "grown_shard"))
    blocks = max(1, rows.count() // (block_rows * tree.n_shards) * 2)
    rows = rows.withColumn("_block", F.floor(uniform("doc_id", salt="slot") * blocks).cast("int"))
    sizes = rows.groupBy("shard", "_block").agg(F.count("*").alias("_rows"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_rows").over(Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_rows")
    numbered = rows.withColumn("_at", F.row_number().over(Window.partitionBy("shard", "_block").orderBy("doc_id", "text_crc32", "size")))
    return numbered.join(before, ["shard", "_block"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_before") + F.col("_at") - 1).cast("long").alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, tree: HashTree, path: str, id_col: str = "doc_id", rows_a_file: int = 1_000_000) -> None:
    """Write docs to path/shard=N/, a shard by as many tasks as it has rows_a_file rows. Columns stay as they are, but one named shard is replaced; rows with null or repeated ids stay.

    Rows are placed where they are, without a join; only the shards' sizes, a row for each shard, are gathered first.
    """
    spread, files = fresh(docs, "_spread", "_files")
    plain = docs.drop("shard")
    names = plain.columns
    placed = place(plain.toDF(*[f"c{i}" for i in range(len(names))]).withColumn("_k", F.col(f"c{names.index(id_col)}")), tree, "_k").drop("_k")
    placed = placed.toDF(*names, "shard")
    sizes = placed.groupBy("shard").agg(F.ceil(F.count("*") / rows_a_file).alias(files))
    # one row for each shard
    # by what a row holds, so that a task that runs again deals its rows the same way
    held = F.xxhash64(*[quoted(f.name) for f in plain.schema.fields if f.dataType.typeName() not in ("map", "variant")])
    dealt = placed.join(F.broadcast(sizes), "shard").withColumn(spread, F.pmod(held, F.col(files)).cast("int"))
    n = sizes.agg(F.coalesce(F.sum(files), F.lit(1))).first()[0]
    dealt.repartition(int(n), "shard", spread).select(*own_columns(plain), "shard").write.partitionBy("shard").parquet(path)
