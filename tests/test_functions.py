"""Scalar functions against plain Python and published cases."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from slotframe.functions import circular, packed
from slotframe.functions.codecs import FILTER_SEEDS, crc64_all, filter_hash
from slotframe.operators import bloom


def leb128(n):
    out = bytearray()
    while True:
        out.append(n & 127 | (128 if n > 127 else 0))
        n >>= 7
        if not n:
            return bytes(out)


def test_varints(spark):
    r = random.Random(1)
    values = [0, 1, 127, 128, 16383, 16384, (1 << 63) - 1] + [r.randrange(1 << (7 * k - 7), 1 << min(63, 7 * k)) for k in range(1, 10) for _ in range(20)]
    df = spark.createDataFrame([(v,) for v in values], "n long")
    rows = df.select("n", packed.varint_size(F.col("n")).alias("size"), packed.varint_hex(F.col("n")).alias("code")).withColumn("back", packed.varint_decode(F.concat("code", F.lit("80")))).collect()
    for x in rows:
        assert x["code"] == leb128(x["n"]).hex() and x["size"] == len(leb128(x["n"]))
        assert (x["back"]["n"], x["back"]["consumed"]) == (x["n"], x["size"])


def test_varint_of_unsigned_and_cut_values(spark):
    row = spark.range(1).select(packed.varint_size(F.lit(-1)).alias("all_ones"), packed.varint_decode(F.lit("8080")).alias("cut"), packed.varint_decode(F.lit("8100")).alias("longer"), packed.varint_decode(F.lit("")).alias("none")).first()
    assert row["all_ones"] == 10 and row["cut"] is None and row["none"] is None
    assert tuple(row["longer"]) == (1, 2)


def test_circular_order(spark):
    word, half = 1 << 64, 1 << 63
    r = random.Random(2)
    pairs = [(r.randrange(word), r.randrange(word)) for _ in range(200)] + [(5, 5), (0, half), (half, 0), (word - 1, 0), (100, 0)]
    df = spark.createDataFrame([(str(a), str(b)) for a, b in pairs], "a string, b string").select(F.col("a").cast("decimal(38,0)"), F.col("b").cast("decimal(38,0)"))
    a, b = F.col("a"), F.col("b")
    got = df.select(circular.less(a, b), circular.difference(a, b), circular.distance(a, b), circular.clamp_distance(a, b), circular.relative_min(a), circular.relative_max(a)).collect()
    less = lambda x, y: (y - x - 1) % word < half
    for (x, y), row in zip(pairs, got):
        signed = (y - x) % word
        want = (less(x, y), signed - word if signed >= half else signed, (x - y) % word if less(y, x) else (y - x) % word, 0 if less(y, x) else (y - x) % word, (x - half + 1) % word, (x + half - 1) % word)
        assert tuple(map(int, row)) == tuple(map(int, want))


def test_page_ids(spark):
    row = spark.range(1).select(packed.page_id(F.lit(7), F.lit((1 << 24) - 1), F.lit(123)).alias("p")).select("p", packed.advance_generation(F.col("p")).alias("n")).select(packed.device_of(F.col("n")), packed.generation_of(F.col("n")), packed.address_of(F.col("n")), packed.same_physical_page(F.col("p"), F.col("n"))).first()
    assert tuple(row) == (7, 0, 123, True)


def crc64_slow(data):
    r = (1 << 64) - 1
    for byte in data:
        r ^= byte << 56
        for _ in range(8):
            r = (r << 1 ^ (0x42F0E1EBA9EA3693 if r >> 63 else 0)) & (1 << 64) - 1
    return r ^ (1 << 64) - 1


def test_crc64():
    values = [b"", b"123456789", b"a" * 300, bytes(range(256)), b"x"]
    assert crc64_all(values).tolist() == [crc64_slow(v) for v in values]
    assert crc64_all([b"123456789"])[0] == 0x62EC59E3F1A4F00A
    assert len(crc64_all([])) == 0


def test_filter_hash(spark):
    import xxhash

    row = spark.createDataFrame([("key", 3), ("key", 67)], "k string, n int").select(filter_hash("k", "n")).collect()
    want = struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(b"key", FILTER_SEEDS[3])))[0]
    assert [x[0] for x in row] == [want, want]


@pytest.mark.parametrize("layout", list(bloom.LAYOUTS))
@pytest.mark.parametrize("n", [1, 2, 12, 100, 500])
def test_filters_miss_nothing(layout, n):
    r = random.Random(15485863)
    items = ["".join(r.choice("abcdefghij") for _ in range(11)).encode() for _ in range(n)]
    for bits in (1.0, 4.7, 10.0, 16.3):
        c = bloom.Config.for_keys(layout, n, bits)
        words = [0] * c.words
        for x in items:
            for w, m in bloom.masks(x, c).items():
                words[w] |= m
        has = lambda x: all(words[w] & m == m for w, m in bloom.masks(x, c).items())
        assert all(map(has, items))
        if n >= 100:
            rate = sum(has(b"q%d" % i) for i in range(2000)) / 2000
            assert rate <= c.error_rate + 0.075


def test_filter_sizes():
    c = bloom.Config.for_error_rate("flat", 1000, 0.01)
    assert c.hashes == 7 and 149 <= c.words <= 151
    assert bloom.Config.for_size("blocked512", 21, 10.0).words == 16
    assert bloom.Config.for_hashes("flat", 100, 5).hashes == 5
    assert bloom.Config.for_size_and_keys("blocked64", 10, 64).bits_per_key == 10.0
