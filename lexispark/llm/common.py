"""What the operators of this subpackage share on the Spark side."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def few_files(docs: DataFrame, most_bytes: int = 128 << 20) -> int:
    """How many files hold what is made of docs, if each is to hold what came of most_bytes of it at most; no more than shuffle partitions, as joins
    are thought larger than they are; 0 if Spark doesn't know the size."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return min(-(-size // most_bytes), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))) if size < 1 << 60 else 0


def checkpointed(df: DataFrame, narrow: bool = False, files: int = 0) -> DataFrame:
    """Cut the lineage by writing df to the reliable checkpoint folder (spark.checkpoint.dir; a temporary one only in local mode, where the session names none).

    narrow: rows of a few numbers, a class or a link each, which many iterations write; they are dealt to as many files as there are cores, not to one for each shuffle partition.
    files: the least number of them, where rows grow with the documents.

    Once it is written nothing reads the shuffles it came from, so Spark is told to remove their files at once instead of when the driver collects garbage.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not (folder := spark.conf.get("spark.checkpoint.dir", None)):
            if not context.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="lexispark-checkpoints-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    if narrow:
        df = df.repartition(max(context.defaultParallelism, files))
    before = spark.conf.get(_FREE_SHUFFLES, "false")
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a plan of its own, made under the setting
    finally:
        spark.conf.set(_FREE_SHUFFLES, before)


def fresh(docs: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, with underscores put before those that docs has already, in whatever case."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def own_columns(docs: DataFrame, without: tuple[str, ...] | list[str] = ()) -> list[Column]:
    """The columns of docs by name, whatever their names hold."""
    left_out = {c.lower() for c in without}
    return [quoted(c) for c in docs.columns if c.lower() not in left_out]


def numbered(docs: DataFrame) -> DataFrame:
    """docs with columns c0, c1, ...: mapInArrow can't take names with a dot. Names come back with toDF()."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def n_words(text: Column) -> Column:
    """Number of words of a text: white space is the six ASCII characters; null has none.

    Word characters are dropped but one for each run, so no array of words is built for a long text.
    """
    return F.length(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "x"), r"[\x20\x09-\x0D]+", "")).cast("long")


def as_double(x: str) -> Column:
    return F.expr(x).cast("double")


def uniform(*parts: Column | str, salt: str = "") -> Column:
    """A number in (0, 1) that the parts decide: 52 bits of MD5, which any engine can recompute."""
    text = F.concat_ws("|", *[F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("~")) for p in parts], F.lit(salt))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))
