"""Fuzzy membership models: gram ratings, thresholds, empirical distributions, joined probabilities, clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexispark.functions.text import ngrams
from lexispark.operators import order
from lexispark.operators.similarity import gram_model

MOST_BUCKETS = 5000


def rate(items: DataFrame, item: str, model: DataFrame, n: int) -> DataFrame:
    """items with rating: ((sum of the model's counts of the item's grams, repeats counted) + 1) / (length + n + 2) / (grams of the model). One row for each distinct item."""
    size = model.agg(F.sum("cnt").alias("size"))
    own = items.select(item).distinct().select(item, F.explode(ngrams(F.col(item), n)).alias("gram"))
    sums = own.join(model, "gram", "left").groupBy(item).agg(F.sum(F.coalesce("cnt", F.lit(0))).alias("_sum"))
    return sums.join(F.broadcast(size)).select(item, ((F.col("_sum") + 1) / (F.length(item) + n + 2) / F.col("size")).alias("rating"))  # size: one row


def threshold(rated: DataFrame, fnr: float) -> DataFrame:
    """(min_rating, deviation, n): the rating at place int(fnr * N) of the ascending ratings, and their population deviation. rated has a row for each training item, repeats counted."""
    counts = rated.groupBy("rating").agg(F.count("*").alias("_n"))
    whole = rated.agg(F.stddev_pop("rating").alias("deviation"), F.count("*").alias("n"))
    n = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    return whole.join(order.place(counts, "rating", "_n", int(fnr * n)).select(F.col("rating").alias("min_rating"))).select("min_rating", "deviation", "n")  # one row each


def train_filter(items: DataFrame, item: str, n: int, fnr: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(model, bounds): bounds is threshold() of the items' ratings. All rows are trained on, repeats counted."""
    model = gram_model(items, item, n)
    return model, threshold(items.select(item).join(rate(items, item, model, n), item), fnr)


def allow(bounds: DataFrame, share: float) -> DataFrame:
    """The bound lowered by a share of itself."""
    if not 0 <= share <= 1:
        raise ValueError("the share must be from 0 to 1")
    return bounds.withColumn("min_rating", F.col("min_rating") * (1 - share))


def steps_to_include(rating: str, bound: str, delta: float):
    """How many times a bound must be lowered by delta until it takes the rating in: the least k with (1 - delta)**k * bound <= rating."""
    return F.when(F.col(rating) >= F.col(bound), F.lit(0)).otherwise(F.ceil(F.log(F.col(rating) / F.col(bound)) / F.log(F.lit(1 - delta)) - 1e-12)).cast("long")


def distribution(values: DataFrame, value: str, most: int = MOST_BUCKETS) -> DataFrame:
    """(bucket, cum, min_val, max_val, granularity, buckets): the cumulative histogram of a sample.

    The granularity is the least gap between different values, coarser if there would be over `most` buckets. Equal values give one bucket.
    """
    distinct = values.select(F.col(value).cast("double").alias("v")).where("v is not null").distinct()
    meta = values.agg(F.min(F.col(value).cast("double")).alias("min_val"), F.max(F.col(value).cast("double")).alias("max_val")).join(order.least_gap(distinct, "v"))  # one row each
    span = F.col("max_val") - F.col("min_val")
    exact = F.floor(span / F.col("gap"))
    meta = meta.withColumn("buckets", F.when(F.col("gap").isNull(), F.lit(1)).when(exact > most, F.lit(most)).otherwise(exact).cast("long"))
    meta = meta.withColumn("granularity", F.when(F.col("gap").isNull(), F.lit(1.0)).when(exact > most, span / most).otherwise(F.col("gap"))).drop("gap")
    placed = values.select(F.col(value).cast("double").alias("v")).join(F.broadcast(meta))  # one row
    placed = placed.withColumn("bucket", F.least(F.floor((F.col("v") - F.col("min_val")) / F.col("granularity")), F.col("buckets") - 1).cast("long"))
    counts = placed.groupBy("bucket", "min_val", "max_val", "granularity", "buckets").agg(F.count("*").alias("c"))
    running = Window.orderBy("bucket")
    return counts.select("bucket", (F.sum("c").over(running.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("c").over(Window.partitionBy())).alias("cum"), "min_val", "max_val", "granularity", "buckets")


def cdf(values: DataFrame, value: str, dist: DataFrame, to: str, whole: bool = False) -> DataFrame:
    """values with the distribution's CDF at each: 0 below the least, 1 from the greatest on, else interpolated within the bucket (a step if whole).

    dist holds buckets that have values; a bucket without has the cum of the one before. It is bounded by the number of buckets, so it is broadcast.
    """
    meta = dist.select("min_val", "max_val", "granularity", "buckets").distinct()
    every = meta.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("buckets") - 1)).alias("bucket")).join(dist.select("bucket", "cum"), "bucket", "left")
    filled = every.withColumn("cum", F.coalesce(F.max("cum").over(Window.orderBy("bucket")), F.lit(0.0)))  # at most MOST_BUCKETS rows
    steps = filled.agg(F.transform(F.sort_array(F.collect_list(F.struct("bucket", "cum"))), lambda s: s["cum"]).alias("steps"))
    x = values.join(F.broadcast(meta.join(steps))).withColumn("_b", (F.col(value) - F.col("min_val")) / F.col("granularity")).withColumn("_l", F.floor("_b"))  # one row
    at = lambda b: F.coalesce(F.get("steps", F.least(F.greatest(b, F.lit(-1)), F.col("buckets")).cast("int")), F.lit(0.0))
    left = at(F.col("_l"))
    inner = left if whole else left + (at(F.col("_l") + 1) - left) * (F.col("_b") - F.col("_l"))
    p = F.when(F.col(value) < F.col("min_val"), F.lit(0.0)).when(F.col(value) >= F.col("max_val"), F.lit(1.0)).when(F.col("_l") >= F.col("buckets") - 1, F.lit(1.0)).otherwise(inner)
    return x.withColumn(to, p).select(*values.columns, to)


def joined_probability(parts: list[tuple[str, float]]):
    """The product of probabilities to the power of their weights; 0 if one is 0."""
    zero = None
    total = None
    for c, w in parts:
        zero = F.col(c) <= 0 if zero is None else zero | (F.col(c) <= 0)
        term = w * F.log(F.when(F.col(c) > 0, F.col(c)))
        total = term if total is None else total + term
    return F.when(zero, F.lit(0.0)).otherwise(F.exp(total))


def cluster_model(members: DataFrame, item: str, cluster: str, n: int) -> DataFrame:
    """(cluster, gram, cnt) over all rows, repeats counted."""
    return members.select(F.col(cluster).alias("cluster"), F.explode(ngrams(F.col(item), n)).alias("gram")).groupBy("cluster", "gram").agg(F.count("*").alias("cnt"))


def rate_by_model(items: DataFrame, item: str, model: DataFrame, cluster: str, n: int) -> DataFrame:
    """(item, cluster, rating): each distinct item against the model (cluster, gram, cnt) of each cluster with which it shares a gram."""
    size = model.groupBy("cluster").agg(F.sum("cnt").alias("size"))
    own = items.select(item).distinct().select(item, F.explode(ngrams(F.col(item), n)).alias("gram"))
    sums = own.join(model, "gram").groupBy(item, "cluster").agg(F.sum("cnt").alias("_sum"))
    return sums.join(size, "cluster").select(item, F.col("cluster").alias(cluster), ((F.col("_sum") + 1) / (F.length(item) + n + 2) / F.col("size")).alias("rating"))


def rate_by_cluster(items: DataFrame, item: str, members: DataFrame, cluster: str, n: int) -> DataFrame:
    """The same for the clusters' members (item, cluster)."""
    return rate_by_model(items, item, cluster_model(members, item, cluster, n), cluster, n)


def best_cluster(rated: DataFrame, item: str, cluster: str) -> DataFrame:
    """The cluster with the highest rating of each item, the first in order of equals."""
    w = Window.partitionBy(item).orderBy(F.col("rating").desc(), cluster)
    return rated.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
