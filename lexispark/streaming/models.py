"""Gram counts kept up to date as names arrive: counts add up, so batches may come in any order and are idempotent by batch id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexispark.operators.similarity import gram_model


def add_names(model: DataFrame, names: DataFrame, item: str, n: int) -> DataFrame:
    """The model (gram, cnt) with the names' grams counted in."""
    return model.unionByName(gram_model(names, item, n)).groupBy("gram").agg(F.sum("cnt").alias("cnt"))


def count_stream(names: DataFrame, item: str, n: int, path: str, checkpoint: str) -> StreamingQuery:
    """Write each micro-batch's gram counts to path/batch=<id>, replacing what a failed attempt left; read_counts() adds them up."""

    def write(batch: DataFrame, batch_id: int) -> None:
        gram_model(batch, item, n).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return names.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_counts(spark, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("gram").agg(F.sum("cnt").alias("cnt"))
