"""Exact dedup: group by a 128-bit content hash, keep the smallest id, compare bytes inside groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotframe.llm.blocked_bloom import possible_hits
from slotframe.llm.common import WHITE, stage
from slotframe.llm.row_keys import keep_rows, keyed_rows, text_key


def normalised(text: Column) -> Column:
    """``text`` with each run of white space replaced by one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{WHITE}]+", " ")


def _repeats(rows: DataFrame, *keys: str) -> DataFrame:
    """The groups of more than one row: their number of rows n, and first, the one that stays."""
    least = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "rid"))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), least.alias("first")).filter("n > 1")


def _judged(docs: DataFrame) -> DataFrame:
    """A row for each row of ``docs``: doc_id, key (of the text as it is), rid, h, text_sha256, n, first.

    ``n`` and ``first`` (least doc_id, null last, then rid) are of the rows with an equal text.
    """
    t = normalised(F.col("text"))
    rows = stage(keyed_rows(docs, F.unhex(F.md5(t)).alias("h"), F.sha2(t, 256).alias("text_sha256")), "dedup-hashes")
    repeats = stage(_repeats(rows, "h"), "dedup-groups")
    wanted = stage(rows.join(repeats.select("h"), "h", "left_semi").select("key").distinct(), "dedup-wanted")
    hits = possible_hits(docs.select(text_key(F.col("text")).alias("key"), "text"), wanted)  # other texts aren't shuffled
    texts = hits.select(normalised(F.col("text")).alias("t"))
    alike = texts.groupBy(F.unhex(F.md5("t")).alias("h"), "t").agg(F.sha2(F.first("t"), 256).alias("text_sha256"))  # equal bytes are one row, before they move
    apart = alike.groupBy("h").agg(F.count(F.lit(1)).alias("texts"), F.countDistinct("text_sha256").alias("digests")).filter("texts > 1")
    collisions, unlike = apart.agg(F.count(F.lit(1)), F.count_if(F.col("texts") > F.col("digests"))).first()
    if not collisions:
        joined = rows.join(repeats, "h", "left")
    elif not unlike:  # different texts share the hash: the other digest tells them apart
        joined = rows.join(_repeats(rows, "h", "text_sha256"), ["h", "text_sha256"], "left")
    else:  # different texts share both digests: the texts themselves are the groups' keys
        rows = stage(keyed_rows(docs, t.cast("binary").alias("h"), F.sha2(t, 256).alias("text_sha256")), "dedup-texts")
        joined = rows.join(_repeats(rows, "h"), "h", "left")
    return joined.select("doc_id", "key", "rid", "text_sha256", F.coalesce("n", F.lit(1)).cast("long").alias("n"), "first")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Rows are grouped by the MD5 of the normalised text; hashes move, not texts. Only texts of hashes that occur more
    than once are then brought together, each once for a map task however many copies it has, and compared as bytes:
    where a hash has more than one text, groups are formed again by both digests, or by the texts if those agree too.

    Nulls and ties: a null text counts as empty. A null doc_id loses to any other; a group of null ids only has
    keep_id null. Of repeated rows (same doc_id, equal text) exactly one is kept. An empty table gives an empty
    result; other columns of ``docs`` are not looked at, so their names can't clash.
    """
    kept = F.col("first").isNull() | (F.col("rid") == F.col("first.rid"))
    keep_id = F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id"))
    return _judged(docs).select("doc_id", keep_id.alias("keep_id"), F.col("n").alias("group_size"), kept.alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``exact_dedup`` drops; one row stays of a repeated doc_id with one text."""
    kept = F.col("first").isNull() | (F.col("rid") == F.col("first.rid"))
    return keep_rows(docs, _judged(docs).select("doc_id", "key", kept.alias("kept")))


ORACLE = """
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AND row_number() OVER (PARTITION BY t, doc_id) = 1 AS kept,
       sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""
