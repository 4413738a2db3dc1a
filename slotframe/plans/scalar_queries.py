"""Queries of scalar functions, circular arithmetic, and the sequence combinators."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotframe.functions import circular, packed
from slotframe.functions.codecs import crc64_hex, double_from_hex, double_hex
from slotframe.functions.names import STATUS
from slotframe.plans.register import query
from slotframe.plans.sql import varint
from slotframe.sources import adapters

C = F.col


def _t(spark, d, name):
    return adapters.table(spark, d, name)


#: Spreads keys over all varint lengths below 2^62.
_N = "(o_orderkey * (1::BIGINT << (o_orderkey % 40)::INTEGER))"


def _wide(spark, d):
    k = C("o_orderkey")
    return _t(spark, d, "orders").select(k, (k * F.expr("shiftleft(1L, cast(o_orderkey % 40 as int))")).alias("n"))


@query(f"SELECT o_orderkey, {_N} AS n, {varint(_N)} AS size FROM orders")
def varint_size(spark, d):
    return _wide(spark, d).select("o_orderkey", "n", packed.varint_size(C("n")).cast("long").alias("size"))


_HEX = f"""array_to_string(list_transform(generate_series(0, {varint('n')} - 1), lambda i: format('{{:02x}}', ((n >> (7 * i)::INTEGER) & 127) + CASE WHEN i < {varint('n')} - 1 THEN 128 ELSE 0 END)), '')"""


@query(f"SELECT o_orderkey, {_HEX} AS code FROM (SELECT o_orderkey, {_N} AS n FROM orders)")
def varint_encode(spark, d):
    return _wide(spark, d).select("o_orderkey", packed.varint_hex(C("n")).alias("code"))


@query(f"SELECT o_orderkey, n, CAST({varint('n')} AS INTEGER) AS consumed FROM (SELECT o_orderkey, {_N} AS n FROM orders)")
def varint_decode(spark, d):
    coded = _wide(spark, d).select("o_orderkey", F.concat(packed.varint_hex(C("n")), F.lit("ff7f")).alias("code"))
    return coded.select("o_orderkey", packed.varint_decode(C("code")).alias("x")).select("o_orderkey", "x.n", "x.consumed")


@query(f"SELECT doc_id, {varint('(1 + octet_length(encode(text)))')} + 1 + octet_length(encode(text)) AS size FROM documents")
def slot_packed_size(spark, d):
    return _t(spark, d, "documents").select("doc_id", packed.slot_packed_size(F.octet_length("text")).cast("long").alias("size"))


@query("SELECT page_id, CAST(8 + CASE WHEN octet_length(encode(url)) <= 4 THEN 0 ELSE octet_length(encode(url)) END AS BIGINT) AS size, CAST(8 + CASE WHEN octet_length(encode(substr(url, 1, 4))) <= 4 THEN 0 ELSE 4 END AS BIGINT) AS inline_size FROM pages")
def str_packed_size(spark, d):
    return _t(spark, d, "pages").select("page_id", packed.str_packed_size(C("url")).alias("size"), packed.str_packed_size(F.substring("url", 1, 4)).alias("inline_size"))


@query("SELECT l_orderkey, 8 + count(*) * 8 AS size FROM lineitem GROUP BY 1")
def array_packed_size(spark, d):
    return _t(spark, d, "lineitem").groupBy("l_orderkey").agg(packed.array_packed_size(F.count(F.lit(1)), 8).alias("size"))


_PAGE = "((3::BIGINT << 56) | ((c_custkey % 100) << 32) | c_custkey)"


def _pages(spark, d):
    return _t(spark, d, "customer").select("c_custkey", packed.page_id(F.lit(3), C("c_custkey") % 100, C("c_custkey")).alias("page_id"))


@query(f"SELECT c_custkey, {_PAGE} AS page_id FROM customer")
def page_id_pack(spark, d):
    return _pages(spark, d)


@query(f"SELECT {_PAGE} AS page_id, 3::BIGINT AS device, c_custkey % 100 AS generation, c_custkey AS address FROM customer")
def page_id_unpack(spark, d):
    p = C("page_id")
    return _pages(spark, d).select(p, packed.device_of(p).alias("device"), packed.generation_of(p).alias("generation"), packed.address_of(p).alias("address"))


@query(f"SELECT {_PAGE} AS page_id, {_PAGE} + (1::BIGINT << 32) AS next FROM customer")
def page_id_advance(spark, d):
    return _pages(spark, d).select("page_id", packed.advance_generation(C("page_id")).alias("next"))


@query("SELECT o_orderkey, o_custkey % 300 - o_orderkey % 300 > 0 AS less FROM orders")
def generation_less_than(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", packed.generation_less_than(C("o_orderkey") % 300, C("o_custkey") % 300).alias("less"))


@query("SELECT c_custkey, c_custkey % 10 <> 0 AS valid FROM customer")
def page_id_valid(spark, d):
    rows = _pages(spark, d)
    return rows.select("c_custkey", packed.is_valid_page_id(F.when(C("c_custkey") % 10 == 0, -1).otherwise(C("page_id"))).alias("valid"))


@query("SELECT c_custkey, c_custkey % 4 <> 0 AS same FROM customer")
def same_physical_page(spark, d):
    k = C("c_custkey")
    other = packed.page_id(F.lit(3), k % 100 + 1, F.when(k % 4 == 0, k + 1).otherwise(k))
    return _pages(spark, d).select("c_custkey", packed.same_physical_page(C("page_id"), other).alias("same"))


@query("SELECT (x.device << 56) | x.k AS page_id, x.device AS device_id, n AS device_name FROM (SELECT o_orderkey AS k, 1 + o_orderkey % 6 AS device FROM orders) x JOIN (VALUES (1, 'region'), (2, 'nation'), (3, 'customer'), (4, 'supplier'), (5, 'orders'), (6, 'part')) v(d, n) ON d = x.device")
def page_device_lookup(spark, d):
    devices = spark.createDataFrame([(v, k) for k, v in adapters.DEVICES.items()], "device_id long, device_name string")
    k = C("o_orderkey")
    rows = _t(spark, d, "orders").select(packed.page_id(k % 6 + 1, F.lit(0), k).alias("page_id"))
    return rows.withColumn("device_id", packed.device_of(C("page_id"))).join(devices, "device_id").select("page_id", "device_id", "device_name")


@query(f"SELECT {_PAGE} AS page_id, ((9::BIGINT << 56) | ((c_custkey % 100) << 32) | c_custkey) AS paired FROM customer")
def paired_page(spark, d):
    return _pages(spark, d).select("page_id", packed.paired_page(C("page_id"), F.lit(9)).alias("paired"))


@query(f"SELECT {_PAGE} AS page_id, CASE WHEN c_custkey % 5 <> 0 THEN ((7::BIGINT << 56) | ((c_custkey % 100) << 32) | ((c_custkey << 3) | (c_custkey % 8))) END AS shard FROM customer")
def page_shard(spark, d):
    k = C("c_custkey")
    device = F.when(k % 5 != 0, 7)
    shard = packed.page_shard(C("page_id"), device, F.lit(12), F.lit(9), (k % 8) * 512)
    return _pages(spark, d).select("page_id", shard.alias("shard"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def sha256(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("SELECT p_partkey, CAST(ceil(log2(p_size * 512)) AS INTEGER) AS log2 FROM part")
def page_size_log2(spark, d):
    return _t(spark, d, "part").select("p_partkey", packed.log2_ceil((C("p_size") * 512).cast("long")).alias("log2"))


@query("SELECT CAST(c AS INTEGER) AS code, n AS name FROM (VALUES " + ", ".join(f"({i}, '{n}')" for i, n in enumerate(STATUS)) + ") v(c, n)")
def status_name(spark, d):
    return spark.createDataFrame(list(enumerate(STATUS)), "code int, name string")


@query("SELECT l_orderkey, l_linenumber, l_partkey, lower(lpad(to_hex(l_partkey), 16, '0')) AS be64, array_to_string(list_transform(generate_series(7, 0, -1), lambda i: substr(lpad(lower(to_hex(l_partkey)), 16, '0'), 1 + 2 * i, 2)), '') AS le64 FROM lineitem")
def int_codec(spark, d):
    k = C("l_partkey")
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", k, packed.int_hex(k, 8, little=False).alias("be64"), packed.int_hex(k, 8).alias("le64"))


@query("SELECT o_orderkey, o_totalprice AS value, true AS restored FROM orders")
def float_codec(spark, d):
    coded = _t(spark, d, "orders").select("o_orderkey", "o_totalprice", double_hex("o_totalprice").alias("code"))
    back = double_from_hex("code")
    return coded.select("o_orderkey", back.alias("value"), (back == C("o_totalprice")).alias("restored"))


@query()
def crc64(spark, d):
    return _t(spark, d, "pages").select("page_id", crc64_hex("html").alias("crc64"))


@query()
def true_crc64(spark, d):
    """The checksum of a block without its last 8 bytes, in which the block keeps it.

    A block has 4096 bytes, or the next power of two that holds the whole url.
    """
    head = F.concat(F.col("url"), F.lit("|"))
    rows = _t(spark, d, "pages").select("page_id", head.alias("head"), F.octet_length(head).alias("n"))
    fill = F.expr("repeat('0', CAST(greatest(4096, shiftleft(1L, length(bin(n + 7)))) - 8 - n AS INT))")
    return rows.select("page_id", crc64_hex(F.concat("head", fill)).alias("crc64"))


@query("SELECT page_id, starts_with(url, 'https://') AS matched, CASE WHEN starts_with(url, 'https://') THEN substr(url, 9) ELSE url END AS rest FROM pages")
def token_match(spark, d):
    hit = C("url").startswith("https://")
    return _t(spark, d, "pages").select("page_id", hit.alias("matched"), F.when(hit, F.substring("url", 9, 1 << 30)).otherwise(C("url")).alias("rest"))


@query("""SELECT page_id, CASE WHEN url IS NULL THEN 'kUnpackCastNullptr' WHEN length(url) < 8 + page_id % 60 THEN 'kUnpackCastStructOver' ELSE 'kOk' END AS status FROM pages""")
def unpack_cast(spark, d):
    need = C("page_id") % 60 + 8
    status = F.when(C("url").isNull(), "kUnpackCastNullptr").when(F.length("url") < need, "kUnpackCastStructOver").otherwise("kOk")
    return _t(spark, d, "pages").select("page_id", status.alias("status"))


@query("SELECT event_id, CASE WHEN event_id % 12 < 10 THEN event_id % 12 END AS which, CASE WHEN event_id % 12 < 10 THEN 'kOk' ELSE 'kBadPackedVariant' END AS status FROM events")
def variant_decode(spark, d):
    """The tag is the first byte of the record."""
    data = F.concat(packed.int_hex(C("event_id") % 12, 1), F.hex(C("props").cast("binary")))
    tag = F.conv(F.substring(data, 1, 2), 16, 10).cast("long")
    return _t(spark, d, "events").select("event_id", F.when(tag < 10, tag).alias("which"), F.when(tag < 10, "kOk").otherwise("kBadPackedVariant").alias("status"))


@query("SELECT count(*) AS n, count(*) AS distinct_ids FROM nation")
def uuid_random(spark, d):
    ids = _t(spark, d, "nation").select(F.uuid().alias("id"))
    return ids.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("distinct_ids"))


# ---- circular order. Offsets near the wrap-around: keys below half of it, or counted back from 2^64.

_A = "(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey::HUGEINT ELSE 18446744073709551616::HUGEINT - o_orderkey END)"
_B = "(CASE WHEN o_custkey % 3 = 0 THEN 18446744073709551616::HUGEINT - o_custkey WHEN o_custkey % 3 = 1 THEN 9223372036854775808::HUGEINT + o_orderkey ELSE o_custkey::HUGEINT END)"
_AB = f"ab AS (SELECT o_orderkey, {_A} AS a, {_B} AS b FROM orders)"
_W, _H = "18446744073709551616::HUGEINT", "9223372036854775808::HUGEINT"


def _mod(x: str) -> str:
    return f"((({x}) % {_W} + {_W}) % {_W})"


_LESS, _GREATER = f"({_mod('b - a - 1')} < {_H})", f"({_mod('a - b - 1')} < {_H})"


def _offsets(spark, d):
    wide = lambda c: c.cast("decimal(38,0)")
    k, c, word, half = C("o_orderkey"), C("o_custkey"), F.lit(str(1 << 64)), F.lit(str(1 << 63))
    a = F.when(k % 2 == 0, wide(k)).otherwise(wide(word) - wide(k))
    b = F.when(c % 3 == 0, wide(word) - wide(c)).when(c % 3 == 1, wide(half) + wide(k)).otherwise(wide(c))
    return _t(spark, d, "orders").select(k, wide(a).alias("a"), wide(b).alias("b"))


@query(f"WITH {_AB} SELECT o_orderkey, {_LESS} AS less, {_GREATER} AS greater FROM ab")
def slot_order(spark, d):
    a, b = C("a"), C("b")
    return _offsets(spark, d).select("o_orderkey", circular.less(a, b).alias("less"), circular.less(b, a).alias("greater"))


@query(f"""WITH {_AB} SELECT o_orderkey, CAST(CASE WHEN {_LESS} THEN a ELSE b END AS VARCHAR) AS least, CAST(CASE WHEN {_LESS} THEN b ELSE a END AS VARCHAR) AS most,
CAST(CASE WHEN {_mod('b - a')} >= {_H} THEN {_mod('b - a')} - {_W} ELSE {_mod('b - a')} END AS VARCHAR) AS difference,
CAST(CASE WHEN {_GREATER} THEN {_mod('a - b')} ELSE {_mod('b - a')} END AS VARCHAR) AS distance, CAST(CASE WHEN {_GREATER} THEN 0 ELSE {_mod('b - a')} END AS VARCHAR) AS clamped FROM ab""")
def slot_arithmetic(spark, d):
    a, b = C("a"), C("b")
    made = {"least": circular.slot_min(a, b), "most": circular.slot_max(a, b), "difference": circular.difference(a, b), "distance": circular.distance(a, b), "clamped": circular.clamp_distance(a, b)}
    return _offsets(spark, d).select("o_orderkey", *(x.cast("string").alias(k) for k, x in made.items()))


@query(f"WITH {_AB} SELECT o_orderkey, CAST({_mod(f'a - ({_H} - 1)')} AS VARCHAR) AS relative_min, CAST({_mod(f'a + ({_H} - 1)')} AS VARCHAR) AS relative_max FROM ab")
def relative_min_max(spark, d):
    return _offsets(spark, d).select("o_orderkey", circular.relative_min(C("a")).cast("string").alias("relative_min"), circular.relative_max(C("a")).cast("string").alias("relative_max"))


@query("SELECT o_orderkey, o_orderkey % 50 + 5 <= o_custkey % 60 AS before, o_custkey % 60 + 7 <= o_orderkey % 50 AS after FROM orders")
def slot_range_order(spark, d):
    wide = lambda c: c.cast("decimal(38,0)")
    lo, other = wide(C("o_orderkey") % 50), wide(C("o_custkey") % 60)
    return _t(spark, d, "orders").select("o_orderkey", circular.range_less(lo + 5, other).alias("before"), circular.range_less(other + 7, lo).alias("after"))


# ---- sequence combinators


@query("SELECT p_partkey, p_size * 2 AS doubled FROM part")
def seq_map(spark, d):
    return _t(spark, d, "part").select("p_partkey", (C("p_size") * 2).alias("doubled"))


@query("SELECT p_partkey, p_size FROM part WHERE p_size > 25")
def seq_filter(spark, d):
    return _t(spark, d, "part").filter("p_size > 25").select("p_partkey", "p_size")


@query("SELECT p_partkey, p_size // 2 AS half FROM part WHERE p_size % 2 = 0")
def seq_filter_map(spark, d):
    half = F.when(C("p_size") % 2 == 0, F.shiftright("p_size", 1))
    return _t(spark, d, "part").select("p_partkey", half.alias("half")).filter("half IS NOT NULL")


@query("SELECT count(*) AS n FROM lineitem")
def seq_count(spark, d):
    return _t(spark, d, "lineitem").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_returnflag, CAST(sum(l_partkey) AS BIGINT) AS total FROM lineitem GROUP BY 1")
def seq_sum(spark, d):
    return _t(spark, d, "lineitem").groupBy("l_returnflag").agg(F.sum("l_partkey").alias("total"))


@query("SELECT o_custkey, bool_or(o_orderstatus = 'F') AS any_true FROM orders GROUP BY 1")
def seq_any_true(spark, d):
    return _t(spark, d, "orders").groupBy("o_custkey").agg(F.bool_or(C("o_orderstatus") == "F").alias("any_true"))


@query("SELECT o_custkey, bool_and(o_orderstatus = 'F') AS all_true FROM orders GROUP BY 1")
def seq_all_true(spark, d):
    return _t(spark, d, "orders").groupBy("o_custkey").agg(F.bool_and(C("o_orderstatus") == "F").alias("all_true"))


@query("SELECT page_id, unnest(string_split(url, '/')) AS part FROM pages")
def seq_flatten(spark, d):
    return _t(spark, d, "pages").select("page_id", F.explode(F.split("url", "/")).alias("part"))


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1")
def seq_collect_vec(spark, d):
    return _t(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("names"))


@query("SELECT event_id, CASE WHEN event_type = 'view' THEN 1 ELSE 2 END AS value FROM events WHERE event_type <> 'error'")
def seq_status_ok(spark, d):
    ok = C("event_type") != "error"
    each = _t(spark, d, "events").select("event_id", F.struct(ok.alias("ok"), F.when(C("event_type") == "view", 1).otherwise(2).alias("value")).alias("status"))
    return each.filter("status.ok").select("event_id", "status.value")
