"""Bloom filters in three layouts, as tables of words."""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotframe.functions.codecs import FILTER_SEEDS

LAYOUTS = {"flat": 0, "blocked64": 1, "blocked512": 8}
_FULL = (1 << 64) - 1
LN2 = math.log(2)


@dataclass(frozen=True)
class Config:
    layout: str
    words: int
    keys: int
    hashes: int
    bits_per_key: float
    error_rate: float

    @property
    def blocks(self) -> int:
        return 1 if self.layout == "flat" else self.words // LAYOUTS[self.layout]

    @staticmethod
    def for_keys(layout: str, keys: int, bits_per_key: float) -> Config:
        """The bits a key are worked out again after the size is rounded up to whole words, or to blocks of 512 bits."""
        words = -(-math.ceil(bits_per_key * keys) // 64)
        words = -(-words // 8) * 8 if layout == "blocked512" else words
        return Config._of(layout, words, keys, words * 64 / keys)

    @staticmethod
    def for_size(layout: str, words: int, bits_per_key: float) -> Config:
        words = words // 8 * 8 if layout == "blocked512" else words
        return Config._of(layout, words, math.floor(words * 64 / bits_per_key), bits_per_key)

    @staticmethod
    def for_hashes(layout: str, words: int, hashes: int) -> Config:
        c = Config.for_size(layout, words, hashes / LN2)
        return Config(layout, c.words, c.keys, hashes, c.bits_per_key, c.error_rate)

    @staticmethod
    def for_size_and_keys(layout: str, words: int, keys: int) -> Config:
        words = words // 8 * 8 if layout == "blocked512" else words
        return Config._of(layout, words, keys, words * 64 / keys)

    @staticmethod
    def for_error_rate(layout: str, keys: int, rate: float) -> Config:
        """By the documented formula, -log2(rate) / ln 2 bits a key."""
        bits = -math.log2(rate) / LN2
        c = Config.for_keys(layout, keys, bits)
        return Config(layout, c.words, keys, math.ceil(bits * LN2), bits, rate)

    @staticmethod
    def _of(layout: str, words: int, keys: int, bits_per_key: float) -> Config:
        return Config(layout, words, keys, math.ceil(bits_per_key * LN2), bits_per_key, 2 ** -(bits_per_key * LN2))


def _reduced(h: int, count: int) -> int:
    """An index below ``count`` by multiply and shift."""
    pre = (count - 1).bit_length() + 1
    return ((h >> pre) * count & _FULL) >> (64 - pre)


def masks(item: bytes, c: Config) -> dict[int, int]:
    """The words of the filter that the item touches, with its bits in each."""
    hashed = lambda n: xxhash.xxh64_intdigest(item, FILTER_SEEDS[n & 63])
    out: dict[int, int] = {}
    if c.layout == "flat":
        for n in range(c.hashes):
            h = hashed(n)
            w = _reduced(h, c.words)
            out[w] = out.get(w, 0) | 1 << (h & 63)
        return out
    wide = LAYOUTS[c.layout]
    in_block = wide.bit_length() - 1
    width = in_block + 6
    first = _reduced(hashed(0), c.blocks) * wide
    source, shift = 1, 0
    for _ in range(c.hashes):
        h = hashed(source)
        w = first + (h >> shift & wide - 1)
        out[w] = out.get(w, 0) | 1 << (h >> shift + in_block & 63)
        shift += width
        if shift == width * (64 // width + 1):
            shift, source = 0, source + 1
    return out


def touched(items: DataFrame, c: Config) -> DataFrame:
    """item, word, mask: a row for each word that an item of ``items`` (item string) touches."""

    @F.pandas_udf("array<struct<word:long,mask:long>>")
    def each(item: pd.Series) -> pd.Series:
        signed = lambda m: m - (1 << 64) if m >> 63 else m
        return pd.Series([[{"word": w, "mask": signed(m)} for w, m in masks(x.encode(), c).items()] for x in item])

    return items.select("item", F.explode(each("item")).alias("x")).select("item", "x.word", "x.mask")


def build(items: DataFrame, c: Config) -> DataFrame:
    """word, bits: the words that hold a bit. Partial ORs are made before the shuffle."""
    return touched(items.filter("item IS NOT NULL"), c).groupBy("word").agg(F.bit_or("mask").alias("bits"))


def might_contain(probes: DataFrame, words: DataFrame, c: Config) -> DataFrame:
    """item, hit of each distinct probe; a word without bits isn't in the table."""
    met = touched(probes.filter("item IS NOT NULL").distinct(), c).join(words, "word", "left")
    has = F.coalesce(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"), F.lit(False))
    return met.groupBy("item").agg(F.bool_and(has).alias("hit"))


def semi_join(probes: DataFrame, build_side: DataFrame, c: Config) -> DataFrame:
    """Rows of ``probes`` whose item is in ``build_side``: the filter drops most others, an exact semi join the rest."""
    hits = might_contain(probes.select("item"), build(build_side, c), c).filter("hit").select("item")
    return probes.join(hits, "item", "left_semi").join(build_side, "item", "left_semi")
