"""Recycling of released pages: pending rows, batches, duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slotframe.operators.log import running

BATCH_SIZE = 24


def latest_state(rows: DataFrame) -> DataFrame:
    return rows.groupBy("page_id").agg(F.max_by(F.struct("depth", "slot", "batch_slot"), "slot").alias("x")).select("page_id", "x.*")


def pending(rows: DataFrame) -> DataFrame:
    """The latest row of each page, unless a batch has it."""
    return latest_state(rows).filter("batch_slot IS NULL").select("page_id", "depth", "slot")


def batch(waiting: DataFrame, size: int = BATCH_SIZE) -> DataFrame:
    """Up to ``size`` pages, all of the greatest depth there is, last in first out."""
    deepest = waiting.agg(F.max("depth").alias("_deepest"))
    return waiting.crossJoin(F.broadcast(deepest)).filter("depth = _deepest").drop("_deepest").orderBy(F.desc("slot"), "page_id").limit(size)


def in_flight(rows: DataFrame, commits: DataFrame) -> DataFrame:
    """Pages of batches that no commit ends, with the flaw of a batch whose pages differ in depth."""
    taken = latest_state(rows).filter("batch_slot IS NOT NULL").join(commits, "batch_slot", "left_anti")
    w = Window.partitionBy("batch_slot")
    mixed = F.min("depth").over(w) != F.max("depth").over(w)
    return taken.select("batch_slot", "page_id", "depth", mixed.alias("mixed_depth"))


def accepted(requests: DataFrame) -> DataFrame:
    """Requests above all that came before in (trim_slot, page_index); others are repeats. ``requests`` have an arrival."""
    rows = running(requests, ("volume",), "arrival", F.struct("trim_slot", "page_index"), "max", "_best", inclusive=False)
    return rows.filter(F.col("_best").isNull() | (F.struct("trim_slot", "page_index") > F.col("_best"))).drop("_best")


def checkpoint(rows: DataFrame, keys: list[str], end: DataFrame, *columns: str) -> DataFrame:
    """The objects to write again at the log's end, oldest first, so that the log can be trimmed to a target.

    ``rows``: keys, slot, columns; an object's latest row counts. ``end``: one row of log_end and trim_target. Gives the
    keys, columns, old_slot, and new_slot from log_end on.
    """
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), "slot").alias("x"), F.max("slot").alias("slot"))
    old = last.crossJoin(F.broadcast(end)).filter("slot < trim_target")
    numbered = running(old, (), "slot", F.lit(1), "sum", "_n")
    return numbered.select(*keys, *(F.col(f"x.{c}").alias(c) for c in columns), F.col("slot").alias("old_slot"), (F.col("log_end") + F.col("_n") - 1).cast("long").alias("new_slot"))


def drop_pages(pages: DataFrame, drops: DataFrame) -> DataFrame:
    """Pages (physical, generation) that the drops (physical, generation) leave.

    A drop removes its own generation of a physical page and older ones, so a repeated or late drop can't harm a page
    that was written there since. A page or a drop without a generation changes nothing: the page stays.
    """
    newest = drops.groupBy("physical").agg(F.max("generation").alias("_dropped"))
    return pages.join(newest, "physical", "left").filter(F.col("_dropped").isNull() | F.col("generation").isNull() | (F.col("generation") > F.col("_dropped"))).drop("_dropped")
