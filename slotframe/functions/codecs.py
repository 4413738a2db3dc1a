"""Hashes, checksums and float codes that Spark lacks, as Arrow-batched functions."""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType

#: CRC-64: polynomial, start value and final mask. Fixed values.
CRC64_POLYNOMIAL, CRC64_START, CRC64_MASK = 0x42F0E1EBA9EA3693, 0xFFFFFFFFFFFFFFFF, 0xFFFFFFFFFFFFFFFF

#: Seeds of the filter hash functions. Fixed values.
FILTER_SEEDS = (
    0xCE3A9EB8B885D5AF, 0x33D9975B8A739AC6, 0xE65D0FFF49425F03, 0x10BB3A132EC4FABC,
    0x88D476F6E7F2C53C, 0xCB4905C588217F44, 0x54EB7B8B55AC05D6, 0xAC0DE731D7F3F97C,
    0x998963E5D908C156, 0x0BDF939D3B7C1CD6, 0x2CF7007C36B2C966, 0xB53C35171F25CCCE,
    0x7D6D2AD5E3EF7AE3, 0xE3AAA3BF1DBFFD08, 0xA81F70B4F8DC0F80, 0x1F4887CE81CDF25A,
    0x6433A69BA9E9D9B1, 0xF859167265201651, 0xE48C6589BE0FF660, 0xADD5250BA0E7AC09,
    0x833F55B86DEE015F, 0xAE3B000FEB85DCEA, 0x0110CFEB4FE23291, 0xF3A5D699AB2CE23C,
    0x7C3A2B8A1C43942C, 0x8CB3FB6783724D25, 0xE3619C66BF3AA139, 0x3FDF358BE099C7D9,
    0x0C38CCABC94A487F, 0x43E19E80EE4FE6ED, 0x22699C9FC26F20EE, 0xA559CBAFFF2CEA37,
    0xFBED4777B17FB16D, 0x7197788291858011, 0xA9325A240F0D996E, 0x6782B2E3766F2F76,
    0xBC3ACA45C9D9DC36, 0x7B687762AFE92061, 0x7B2A7CB985790BCF, 0xF244ED1BC2B06F7D,
    0x29ACD54FF9CB3809, 0xE1926523E6F67949, 0x98F964FBC223BB91, 0xAAB5EE47827C5506,
    0x0DAB726106A4C8DD, 0xA88BB10B8E57CDD9, 0xBEF7EDE281A687AF, 0x0E2A6B9BC5B7D6E3,
    0x5B6F250B605200C8, 0xAFE46BBD0E81722F, 0xB5D978E72AC594DA, 0x8C4362498B85FFF9,
    0xCE8CD0D29A933471, 0x9C2A28AABD1E71CB, 0x572C8C1D4EA24D86, 0x8FC7DFF3AFB5FBF7,
    0xF378BC6C41606BF9, 0xA4C36401CF7A557F, 0x0B0A5BDD27F682AF, 0x3FBE0F66EF4777C1,
    0x0ED678CCBD246356, 0xC2D3489AFC4EDCD6, 0xC482A884240966C6, 0x19B952DB37267518,
)


@cache
def _crc64_table() -> np.ndarray:
    out = np.zeros(256, np.uint64)
    for i in range(256):
        r = i << 56
        for _ in range(8):
            r = ((r << 1) ^ (CRC64_POLYNOMIAL if r >> 63 else 0)) & 0xFFFFFFFFFFFFFFFF
        out[i] = r
    return out


def crc64_all(values: list[bytes]) -> np.ndarray:
    """CRC-64 of each value; all values advance together, a byte at a time, the longest first in line."""
    table, n = _crc64_table(), len(values)
    size = np.fromiter(map(len, values), np.int64, n)
    order = np.argsort(-size, kind="stable")
    begin = (np.cumsum(size) - size)[order]
    size, data = size[order], np.frombuffer(b"".join(values), np.uint8).astype(np.uint64)
    r = np.full(n, CRC64_START, np.uint64)
    for i in range(int(size.max(initial=0))):
        k = int(np.searchsorted(-size, -i, "left"))
        r[:k] = table[(r[:k] >> np.uint64(56)) ^ data[begin[:k] + i]] ^ (r[:k] << np.uint64(8))
    out = np.zeros(n, np.uint64)
    out[order] = r ^ np.uint64(CRC64_MASK)
    return out


def _hex(x: np.ndarray) -> pd.Series:
    return pd.Series([f"{v:016x}" for v in x.tolist()])


@F.pandas_udf(StringType())
def crc64_hex(data: pd.Series) -> pd.Series:
    """CRC-64 of binary or text as 16 hex digits; null counts as empty."""
    return _hex(crc64_all([x.encode() if isinstance(x, str) else bytes(x) if x is not None else b"" for x in data]))


@F.pandas_udf(LongType())
def filter_hash(item: pd.Series, n: pd.Series) -> pd.Series:
    """The n-th filter hash of a text, as the long of equal bits: XXH64 under the n-th seed, modulo 64 seeds. Null counts as empty."""
    return pd.Series([xxhash.xxh64_intdigest((x or "").encode(), FILTER_SEEDS[int(k) & 63]) for x, k in zip(item, n)], dtype="uint64").astype("int64")


@F.pandas_udf(StringType())
def double_hex(x: pd.Series) -> pd.Series:
    """IEEE-754 bits of a double, lowest byte first, as hex."""
    return pd.Series([v.tobytes().hex() for v in x.to_numpy("<f8")])


@F.pandas_udf(DoubleType())
def double_from_hex(x: pd.Series) -> pd.Series:
    """The double of ``double_hex``; null for null."""
    known = x.notna()
    out = pd.array([None] * len(x), dtype="Float64")
    out[known.to_numpy()] = np.frombuffer(bytes.fromhex("".join(x[known])), "<f8")
    return pd.Series(out)
