"""A blocked Bloom filter as a table of blocks: which rows of a table can't have their key in another one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotframe.llm.common import stage

#: A block of the filter has so many 64-bit words; a key sets one bit in each.
BLOCK_WORDS = 8
BITS_PER_KEY = 16
#: Up to this size the filter goes to all executors; a larger one is joined by block.
BROADCAST_BYTES = 32 << 20


def _bits(key: Column) -> list[Column]:
    """The bit of each word of a key's block."""
    h = F.xxhash64(key, F.lit("bits"))
    return [(F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63))).cast("int") for i in range(BLOCK_WORDS)]


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks))


def build_filter(listed: DataFrame, n_blocks: int, key: str = "key") -> DataFrame:
    """The filter's blocks that hold a key: block, w0 .. w7."""
    masks = [F.expr(f"shiftleft(1L, b{i})").alias(f"m{i}") for i in range(BLOCK_WORDS)]
    keyed = listed.select(_block(F.col(key), n_blocks).alias("block"), *(b.alias(f"b{i}") for i, b in enumerate(_bits(F.col(key)))))
    return keyed.select("block", *masks).groupBy("block").agg(*(F.bit_or(f"m{i}").alias(f"w{i}") for i in range(BLOCK_WORDS)))


def marked(rows: DataFrame, listed: DataFrame, key: str = "key") -> DataFrame:
    """``rows`` with ``maybe``: false where ``key`` isn't in ``listed``; true for about 1 in 1,000 others wrongly.

    A null key is never listed. ``rows`` must not have columns named block, maybe, or w0 to w7.
    """
    n_blocks = max(1, -(-listed.count() * BITS_PER_KEY // (64 * BLOCK_WORDS)))
    blocks = stage(build_filter(listed, n_blocks, key), "bloom-blocks")
    if n_blocks * 8 * (BLOCK_WORDS + 1) <= BROADCAST_BYTES:
        blocks = F.broadcast(blocks)
    hit = F.lit(True)
    for i, bit in enumerate(_bits(F.col(key))):
        hit = hit & (F.getbit(f"w{i}", bit) == 1)
    met = rows.withColumn("block", _block(F.col(key), n_blocks)).join(blocks, "block", "left")
    return met.select(*rows.columns, F.coalesce(F.col(key).isNotNull() & hit, F.lit(False)).alias("maybe"))


def possible_hits(rows: DataFrame, listed: DataFrame, key: str = "key") -> DataFrame:
    """The rows whose ``key`` the filter of ``listed`` can't rule out."""
    return marked(rows, listed, key).filter("maybe").drop("maybe")
