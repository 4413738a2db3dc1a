"""Ordered key lookup and byte-wise comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotframe.operators.staging import stage


def _counted(rows: DataFrame, value: str, out: str) -> DataFrame:
    """Add ``out``, the sum of ``value`` over rows (distinct in key) up to this one in byte order.

    Rows are dealt out by ranges of the key that Spark chooses by sample, so that a prefix which most keys share
    doesn't bring them to one task. The ranges are written, since two plans must see the same ones.
    """
    parts = stage(rows.repartitionByRange("key").withColumn("_part", F.spark_partition_id()), "key-ranges")
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.groupBy("_part").agg(F.sum(value).alias("_s"))
    before = sums.select("_part", F.coalesce(F.sum("_s").over(upto), F.lit(0)).alias("_before"))  # one row a range
    inside = F.sum(value).over(Window.partitionBy("_part").orderBy("key").rowsBetween(Window.unboundedPreceding, 0))
    met = parts.withColumn("_in", inside).join(before, "_part")
    return met.withColumn(out, (F.col("_in") + F.col("_before")).cast("long")).drop("_part", "_in", "_before")


def ranked(keys: DataFrame) -> DataFrame:
    """(i, key): the distinct keys in byte order, from 0. Null is no key."""
    rows = keys.select("key").filter("key IS NOT NULL").distinct().withColumn("_one", F.lit(1))
    return _counted(rows, "_one", "i").select((F.col("i") - 1).alias("i"), "key")


def find(keys: DataFrame, probes: DataFrame) -> DataFrame:
    """(probe, lo, hi): the positions of keys equal to the probe, [count less, count not greater).

    Keys and probes are laid out together in byte order. An absent key has an empty range at its place.
    """
    both = keys.select("key").distinct().select("key", F.lit(1).alias("_own")).unionByName(probes.select(F.col("probe").alias("key"), F.lit(0).alias("_own")))
    rows = both.filter("key IS NOT NULL").groupBy("key").agg(F.sum("_own").alias("_own"), F.bool_or(F.col("_own") == 0).alias("_probe"))
    met = _counted(rows, "_own", "hi").filter("_probe")
    return met.select(F.col("key").alias("probe"), (F.col("hi") - F.col("_own")).alias("lo"), "hi")


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by bytes; a prefix comes first."""
    return F.when(a < b, -1).when(a == b, 0).otherwise(1)


def common_prefix(a: Column, b: Column, skip: int = 0) -> Column:
    """The longest prefix that both have after ``skip`` bytes (of ASCII texts)."""
    x, y = F.substr(a, F.lit(skip + 1)), F.substr(b, F.lit(skip + 1))
    n = F.least(F.length(x), F.length(y))
    spots = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    same = lambda i: F.call_function("substring", x, F.lit(1), i) == F.call_function("substring", y, F.lit(1), i)
    return F.call_function("substring", x, F.lit(1), F.coalesce(F.array_max(F.filter(spots, same)), F.lit(0)))


def kth_byte_less(text: Column, k: int, byte: int) -> Column:
    """Whether the k-th byte (from 0) is below ``byte``; texts that end before it are."""
    there = F.octet_length(text) > k
    return F.when(there, F.conv(F.hex(F.substring(text.cast("binary"), k + 1, 1)), 16, 10).cast("int") < byte).otherwise(True)


def zone_map(rows: DataFrame, page: str, key: str) -> DataFrame:
    """Least and greatest key of each page."""
    return rows.groupBy(page).agg(F.min(key).alias("min_key"), F.max(key).alias("max_key"))
