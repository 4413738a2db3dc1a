"""Rows told apart by doc_id and text, and tables without the rows that an operator drops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotframe.llm.blocked_bloom import marked
from slotframe.llm.common import stage


def text_key(text: Column) -> Column:
    """SHA-256 of a text as it is, in 32 bytes; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def keyed_rows(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, key (``text_key``), rid (a number of its own) of each row of ``docs``, and ``more`` columns of it.

    To be staged before use, as a row's number holds only for one run of the plan.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"), F.monotonically_increasing_id().alias("rid"), *more)


def keep_rows(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``judged`` (doc_id, key, kept) keeps; rows are told apart by doc_id and text.

    Rows that are equal in both stay as one where one of them is kept: the one with the smallest digest of all its
    columns. A Bloom filter of what isn't simply kept passes most rows at once; only its possible hits are joined, so
    texts that stay aren't shuffled.
    """
    odd = judged.groupBy("doc_id", "key").agg(F.bool_or("kept").alias("_any"), F.count(F.lit(1)).alias("_rows")).filter("NOT _any OR _rows > 1")
    odd = stage(odd.select(F.coalesce("doc_id", F.lit(-1)).alias("_id"), F.col("doc_id").isNull().alias("_null"), F.col("key").alias("_key"), "_any"), "odd-rows")
    doc_id = docs["doc_id"].cast("long")
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(doc_id, F.lit(-1)).alias("_id"), doc_id.isNull().alias("_null"), text_key(docs["text"]).alias("_key"))
    on = ["_id", "_null", "_key"]
    seen = marked(rows, odd, "_key")
    plain = seen.filter("NOT maybe").unionByName(seen.filter("maybe").join(odd, on, "left_anti")).select("row.*")
    twice = odd.filter("_any")
    if twice.isEmpty():
        return plain
    first = F.row_number().over(Window.partitionBy(*on).orderBy(F.md5(F.col("row").cast("string"))))
    return plain.unionByName(seen.filter("maybe").join(twice, on, "left_semi").withColumn("_n", first).filter("_n = 1").select("row.*"))
