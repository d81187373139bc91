"""Trained membership filters as tables that can be added to, kept and loaded again: of grams, of clusters of grams, of bits."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexispark.operators import models, store
from lexispark.operators.similarity import gram_model


@dataclass(frozen=True)
class GramFilter:
    """Items whose rating reaches the bound. training has (item), a row for each training item; it goes with cleaned(), and the bound stays as it is then."""

    n: int
    fnr: float
    model: DataFrame
    bounds: DataFrame
    training: DataFrame | None

    @staticmethod
    def train(items: DataFrame, item: str, n: int, fnr: float = 0.0) -> GramFilter:
        own = items.select(F.col(item).alias("item"))
        return GramFilter(n, fnr, *models.train_filter(own, "item", n, fnr), own)

    def rate(self, items: DataFrame, item: str) -> DataFrame:
        return models.rate(items, item, self.model, self.n)

    def contains(self, items: DataFrame, item: str) -> DataFrame:
        """(item, member) of each distinct item."""
        return self.rate(items, item).join(F.broadcast(self.bounds.select("min_rating"))).select(item, (F.col("rating") >= F.col("min_rating")).alias("member"))  # one row

    def add(self, items: DataFrame, item: str) -> GramFilter:
        """Counts the items' grams in. The bound stays until updated()."""
        both = self.model.unionByName(gram_model(items, item, self.n))
        return replace(self, model=both.groupBy("gram").agg(F.sum("cnt").alias("cnt")))

    def updated(self) -> GramFilter:
        """With the bound that the training items have under the model as it is now; added items aren't among them."""
        if self.training is None:
            raise ValueError("the training items were cleaned away")
        return replace(self, bounds=models.threshold(self.training.join(self.rate(self.training, "item"), "item"), self.fnr))

    def allowed(self, share: float = 0.1) -> GramFilter:
        return replace(self, bounds=models.allow(self.bounds, share))

    def cleaned(self) -> GramFilter:
        return replace(self, training=None)

    def save(self, path: str) -> None:
        self.model.write.mode("overwrite").parquet(f"{path}/model")
        self.bounds.withColumns({"gram_length": F.lit(self.n), "fnr": F.lit(float(self.fnr))}).write.mode("overwrite").parquet(f"{path}/bounds")
        if self.training is not None:
            self.training.write.mode("overwrite").parquet(f"{path}/training")
        else:
            store.clean(self.model.sparkSession, f"{path}/training")

    @staticmethod
    def load(spark: SparkSession, path: str) -> GramFilter:
        bounds = spark.read.parquet(f"{path}/bounds")
        own = bounds.first()
        training = spark.read.parquet(f"{path}/training") if store.exists(spark, f"{path}/training") else None
        return GramFilter(own["gram_length"], own["fnr"], spark.read.parquet(f"{path}/model"), bounds.drop("gram_length", "fnr"), training)


@dataclass(frozen=True)
class ClusterFilter:
    """A gram filter for each cluster; an item is in if it is in one of them. model: (cluster, gram, cnt); bounds: (cluster, min_rating, deviation, n)."""

    n: int
    fnr: float
    model: DataFrame
    bounds: DataFrame
    training: DataFrame | None

    @staticmethod
    def train(members: DataFrame, cluster: str, item: str, n: int, fnr: float = 0.0) -> ClusterFilter:
        own = members.select(F.col(cluster).alias("cluster"), F.col(item).alias("item"))
        model = models.cluster_model(own, "item", "cluster", n)
        return ClusterFilter(n, fnr, model, own.limit(0), own).updated()

    def rate(self, items: DataFrame, item: str) -> DataFrame:
        """(item, cluster, rating) for each distinct item and each cluster with which it shares a gram."""
        return models.rate_by_model(items, item, self.model, "cluster", self.n)

    def best(self, items: DataFrame, item: str) -> DataFrame:
        return models.best_cluster(self.rate(items, item), item, "cluster")

    def contains(self, items: DataFrame, item: str) -> DataFrame:
        rated = self.rate(items, item).join(self.bounds.select("cluster", "min_rating"), "cluster")
        found = rated.groupBy(item).agg(F.bool_or(F.col("rating") >= F.col("min_rating")).alias("member"))
        return items.select(item).distinct().join(found, item, "left").select(item, F.coalesce("member", F.lit(False)).alias("member"))

    def add(self, items: DataFrame, item: str) -> ClusterFilter:
        """Each row's grams are counted into the cluster that rates it best now; items added together don't see one another. Items without a cluster are left out."""
        where = self.best(items, item).select(item, "cluster")
        more = models.cluster_model(items.select(item).join(where, item), item, "cluster", self.n)
        return replace(self, model=self.model.unionByName(more).groupBy("cluster", "gram").agg(F.sum("cnt").alias("cnt")))

    def updated(self) -> ClusterFilter:
        """With the bounds that each cluster's training items have under its model as it is now."""
        if self.training is None:
            raise ValueError("the training items were cleaned away")
        rated = self.training.join(self.rate(self.training, "item"), ["item", "cluster"])
        # equal ratings together first, so that a large cluster is ordered by its distinct ratings
        counts = rated.groupBy("cluster", "rating").agg(F.count("*").alias("_n"))
        own = Window.partitionBy("cluster")
        placed = counts.withColumn("_all", F.sum("_n").over(own)).withColumn("_upto", F.sum("_n").over(own.orderBy("rating")))
        low = placed.where(F.col("_upto") > F.floor(F.lit(self.fnr) * F.col("_all"))).groupBy("cluster").agg(F.min("rating").alias("min_rating"))
        return replace(self, bounds=low.join(rated.groupBy("cluster").agg(F.stddev_pop("rating").alias("deviation"), F.count("*").alias("n")), "cluster"))

    def allowed(self, share: float = 0.1) -> ClusterFilter:
        return replace(self, bounds=models.allow(self.bounds, share))

    def stretched(self, items: DataFrame, item: str, delta: float = 0.1) -> ClusterFilter:
        """With each cluster's bound lowered, in steps of delta of itself, until the items that it rates best are in."""
        best = self.best(items, item).join(self.bounds.select("cluster", "min_rating"), "cluster")
        steps = best.groupBy("cluster").agg(F.max(models.steps_to_include("rating", "min_rating", delta)).alias("_k"))
        lower = F.col("min_rating") * F.pow(F.lit(1 - delta), F.coalesce("_k", F.lit(0)))
        return replace(self, bounds=self.bounds.join(steps, "cluster", "left").withColumn("min_rating", lower).drop("_k"))

    def stats(self) -> DataFrame:
        """(cluster, min_rating, deviation, n, first): of each cluster, with its first item in order while the training items are there."""
        if self.training is None:
            return self.bounds.withColumn("first", F.lit(None).cast("string"))
        return self.bounds.join(self.training.groupBy("cluster").agg(F.min("item").alias("first")), "cluster", "left")

    def cleaned(self) -> ClusterFilter:
        return replace(self, training=None)

    save = GramFilter.save

    @staticmethod
    def load(spark: SparkSession, path: str) -> ClusterFilter:
        own = GramFilter.load(spark, path)
        return ClusterFilter(own.n, own.fnr, own.model, own.bounds, own.training)


#: Bits of a Bloom filter's block, and bits set for a word.
_BLOCK, _PROBES = 256, 7


@dataclass(frozen=True)
class BloomSet:
    """A set of words as bits, in blocks of 256 (block, w0 to w3): no word of the set is missed, others are taken for members now and then. blocks: how many there are."""

    bits: DataFrame
    blocks: int

    @staticmethod
    def build(members: DataFrame, member: str, bits_a_word: int = 12) -> BloomSet:
        own = members.select(F.col(member).alias("_m")).where("_m is not null").distinct()
        blocks = max(1, -(-own.count() * bits_a_word // _BLOCK))
        block, words = BloomSet._bits(F.col("_m"), blocks)
        table = own.select(block.alias("block"), *[w.alias(f"w{i}") for i, w in enumerate(words)]).groupBy("block")
        return BloomSet(table.agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(_BLOCK // 64)]), blocks)

    @staticmethod
    def _bits(word, blocks: int):
        hashes = F.xxhash64(word), F.xxhash64(word, F.lit(1))
        places = [F.shiftrightunsigned(hashes[1], 8 * i).bitwiseAND(F.lit(_BLOCK - 1)) for i in range(_PROBES)]
        words = []
        for w in range(_BLOCK // 64):
            out = F.lit(0).cast("long")
            for p in places:
                bit = F.call_function("shiftleft", F.lit(1).cast("long"), p.bitwiseAND(F.lit(63)).cast("int"))
                out = out.bitwiseOR(F.when(F.shiftright(p, 6) == w, bit).otherwise(F.lit(0).cast("long")))
            words.append(out)
        return F.pmod(hashes[0], F.lit(blocks)), words

    def may_contain(self, words: DataFrame, word: str) -> DataFrame:
        """words that may be members, by an equi-join on the block."""
        block, own = BloomSet._bits(F.col(word), self.blocks)
        asked = words.withColumns({"block": block, **{f"_m{i}": w for i, w in enumerate(own)}})
        held = F.lit(True)
        for i in range(_BLOCK // 64):
            held = held & (F.col(f"w{i}").bitwiseAND(F.col(f"_m{i}")) == F.col(f"_m{i}"))
        return asked.join(self.bits, "block").where(held).select(*words.columns)

    def save(self, path: str) -> None:
        self.bits.withColumn("blocks", F.lit(self.blocks)).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> BloomSet:
        table = spark.read.parquet(path)
        row = table.select("blocks").first()
        return BloomSet(table.drop("blocks"), row["blocks"] if row else 1)

