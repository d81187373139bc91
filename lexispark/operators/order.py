"""Order over a whole table without one task that holds it: ranges are sorted by themselves, and offset by the sums of those before."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexispark.session import checkpointed


def _ranges(df: DataFrame, by: str) -> DataFrame:
    """df in ranges of a column, with _p, the range's number. Written, so that a range is the same whenever it is read."""
    return checkpointed(df.repartitionByRange(F.col(by).asc()).withColumn("_p", F.spark_partition_id()))


def running(counts: DataFrame, by: str, weight: str, to: str) -> DataFrame:
    """counts with the sum of weight over the rows whose `by` is less. `by` has no equal values and no nulls."""
    own = _ranges(counts, by)
    sums = own.groupBy("_p").agg(F.sum(weight).alias("_w"))
    # one row for each range
    before = sums.select("_p", F.coalesce(F.sum("_w").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    inside = F.coalesce(F.sum(weight).over(Window.partitionBy("_p").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return own.withColumn("_i", inside).join(F.broadcast(before), "_p").withColumn(to, (F.col("_o") + F.col("_i")).cast("long")).drop("_p", "_o", "_i")


def place(counts: DataFrame, by: str, weight: str, at) -> DataFrame:
    """(by): the value at place `at` (a number or a column, from 0) of all, each `by` repeated `weight` times. No row if there are fewer."""
    return running(counts, by, weight, "_before").where((F.col("_before") <= at) & (F.col("_before") + F.col(weight) > at)).select(by)


def least_gap(distinct: DataFrame, by: str) -> DataFrame:
    """(gap): the least difference of neighbours among different values; null for fewer than two."""
    own = _ranges(distinct, by)
    inside = own.select((F.col(by) - F.lag(by).over(Window.partitionBy("_p").orderBy(by))).alias("gap"))
    ends = own.groupBy("_p").agg(F.min(by).alias("_a"), F.max(by).alias("_b"))  # one row for each range
    between = ends.select((F.col("_a") - F.lag("_b").over(Window.orderBy("_p"))).alias("gap"))
    return inside.union(between).agg(F.min("gap").alias("gap"))
