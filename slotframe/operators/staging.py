"""Tables written to the folder that the cluster shares, to cut lineage and fix what a later step reads."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder, as in tests.
LOCAL_SHARED_DIR = "/tmp/checkpoints/slotframe"


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in the folder of spark.checkpoint.dir, which only a session on one machine may leave unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{(folder or LOCAL_SHARED_DIR).rstrip('/')}/slotframe-{what}-{uuid.uuid4().hex}"


def stage(df: DataFrame, what: str = "table") -> DataFrame:
    """Write ``df`` as Parquet and read it back; a lost executor then costs no earlier step."""
    path = shared_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_counted(df: DataFrame, what: str = "table") -> tuple[DataFrame, int]:
    """``stage``, and the number of rows, which is counted as they are written."""
    seen = Observation()
    out = stage(df.observe(seen, F.count(F.lit(1)).alias("rows")), what)
    return out, seen.get["rows"]
