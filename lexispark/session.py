"""Sessions and tables."""

from __future__ import annotations

import atexit
import hashlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", name: str = "lexispark", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine; on a cluster, use the session you are given."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints: what spark.checkpoint.dir names; a temporary one only in local mode, where it names none."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not (folder := spark.conf.get("spark.checkpoint.dir", None)):
            if not context.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="lexispark-checkpoints-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage by writing df to the folder for checkpoints."""
    _shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def work_folder(spark: SparkSession, name: str | None = None) -> str:
    """A path under the folder for checkpoints, for tables that a session builds for itself: a new one, or the same for the same name."""
    return f"{_shared_folder(spark)}/work-{hashlib.md5(name.encode()).hexdigest() if name else uuid.uuid4().hex}"
