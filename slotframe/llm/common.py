"""What the operators of this package share: table access, the shared folder, word rules, prefix sums."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Characters that separate words, as a regular expression class body.
WHITE = r"\x20\x09-\x0D"
#: Used only where the session names no shared folder, as in tests.
LOCAL_SHARED_DIR = "/tmp/checkpoints/slotframe"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where that is unset.

    Only a session on one machine may leave it unset: elsewhere each executor would write to its own disk.
    """
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return LOCAL_SHARED_DIR


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/slotframe-{what}-{uuid.uuid4().hex}"


def stage(df: DataFrame, what: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage, survives a lost executor."""
    path = new_path(df.sparkSession, what)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of text that pass between Spark and a Python worker at once.
TEXT_ROWS = 1000


def text_batches(df: DataFrame) -> DataFrame:
    """``df``, after the session's Arrow batches have been made small enough for whole texts.

    The setting holds for the session, as it is read when a plan runs; a smaller one is left as it is. Spark itself
    ends a batch at spark.sql.execution.arrow.maxBytesPerBatch bytes, so that long texts come in smaller batches.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= TEXT_ROWS:
        conf.set(key, str(TEXT_ROWS))
    return df


def words(text: Column) -> Column:
    """Number of words of ``text``; null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[^{WHITE}]+")).cast("long")


def prefix_sums(df: DataFrame, keys: list[str], order: str, value: str, out: str, step: int = 1024) -> DataFrame:
    """Add ``out``: the sum of ``value`` over rows of equal ``keys`` and smaller ``order`` (unique within keys, from 0).

    Two levels of windows, so that no task sorts more than ``step`` rows, or rows / ``step``, of one key.
    """
    level = df.withColumn("_g", F.expr(f"{order} div {step}"))
    inner = Window.partitionBy(*keys, "_g").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*keys).orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    groups = level.groupBy(*keys, "_g").agg(F.sum(value).alias("_s")).select(*keys, "_g", F.coalesce(F.sum("_s").over(outer), zero).alias("_before"))
    within = level.withColumn("_in", F.coalesce(F.sum(value).over(inner), zero))
    return within.join(groups, [*keys, "_g"]).withColumn(out, F.col("_in") + F.col("_before")).drop("_g", "_in", "_before")
