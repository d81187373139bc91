"""Tables that are built once: in any store that Spark writes to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table was written there to its end."""
    files, place = _at(spark, f"{path}/_SUCCESS")
    return files.exists(place)


def exists_file(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or a folder."""
    files, place = _at(spark, path)
    return files.exists(place)


def clean(spark: SparkSession, path: str) -> None:
    """Delete the table, if there is one."""
    files, place = _at(spark, path)
    files.delete(place, True)


def built(spark: SparkSession, path: str, make: Callable[[], DataFrame], rebuild: bool = False) -> DataFrame:
    """The table at path; made and written first where it is not there, or to be built anew. A table is read back, so later builds don't depend on how it was made."""
    if rebuild or not exists(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
