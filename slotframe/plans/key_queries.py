"""Queries on ordered keys, Bloom filters and page zones."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotframe.functions.codecs import filter_hash
from slotframe.operators import bloom, keys
from slotframe.plans.register import query
from slotframe.sources import adapters

C = F.col


def _names(spark, d):
    return adapters.table(spark, d, "part").select(C("p_name").alias("key")).unionByName(adapters.table(spark, d, "pages").select(C("url").alias("key")))


_KEYS = "k AS (SELECT p_name AS key FROM part UNION SELECT url FROM pages)"


@query(f"WITH {_KEYS} SELECT row_number() OVER (ORDER BY key) - 1 AS i, key FROM k")
def trie_get_key(spark, d):
    return keys.ranked(_names(spark, d))


@query(f"""WITH {_KEYS}, p AS (SELECT DISTINCT c_mktsegment AS probe FROM customer UNION SELECT url FROM pages UNION SELECT url || 'x' FROM pages)
SELECT probe, (SELECT count(*) FROM k WHERE key < probe) AS lo, (SELECT count(*) FROM k WHERE key <= probe) AS hi FROM p""")
def trie_find(spark, d):
    pages = adapters.table(spark, d, "pages")
    probes = adapters.table(spark, d, "customer").select(C("c_mktsegment").alias("probe")).unionByName(pages.select(C("url").alias("probe"))).unionByName(pages.select(F.concat("url", F.lit("x")).alias("probe")))
    return keys.find(_names(spark, d), probes)


_PAIR = "q AS (SELECT page_id, url AS a, lag(url) OVER (ORDER BY page_id) AS b FROM pages)"


def _pairs(spark, d):
    """Each page's url beside that of the page before it by id."""
    pages = adapters.table(spark, d, "pages").select("page_id", C("url").alias("a"))
    return pages.join(pages.select((C("page_id") + 1).alias("page_id"), C("a").alias("b")), "page_id")


@query("""SELECT x.page_id, substr(x.url, 1, coalesce(list_max(list_filter(generate_series(1, least(length(x.url), length(y.url))), lambda i: x.url[1:i] = y.url[1:i])), 0)::INTEGER) AS common
FROM pages x JOIN pages y ON y.page_id = x.page_id - 1""")
def common_prefix(spark, d):
    return _pairs(spark, d).select("page_id", keys.common_prefix(C("a"), C("b")).alias("common"))


@query("SELECT x.page_id, CASE WHEN x.url < y.url THEN -1 WHEN x.url = y.url THEN 0 ELSE 1 END AS cmp FROM pages x JOIN pages y ON y.page_id = x.page_id - 1")
def key_order(spark, d):
    return _pairs(spark, d).select("page_id", keys.compare(C("a"), C("b")).alias("cmp"))


@query("SELECT page_id, CASE WHEN octet_length(encode(url)) > 9 THEN ascii(substr(url, 10, 1)) < 112 ELSE true END AS less FROM pages")
def kth_byte_compare(spark, d):
    return adapters.table(spark, d, "pages").select("page_id", keys.kth_byte_less(C("url"), 9, 112).alias("less"))


@query("SELECT x.page_id, x.url < y.url AS before_closed, x.url <= y.url AS before_open, x.url > y.url AS after_closed FROM pages x JOIN pages y ON y.page_id = x.page_id - 1")
def key_range_order(spark, d):
    """A key against an interval that begins at another key: excluded below a closed bound, and at an open one."""
    return _pairs(spark, d).select("page_id", (C("a") < C("b")).alias("before_closed"), (C("a") <= C("b")).alias("before_open"), (C("a") > C("b")).alias("after_closed"))


@query("SELECT source AS page, min(lang) AS min_key, max(lang) AS max_key FROM documents GROUP BY 1")
def min_key_max_key(spark, d):
    return keys.zone_map(adapters.table(spark, d, "documents").select(C("source").alias("page"), "lang"), "page", "lang")


_BITS = 10.0


def _ids(spark, d, name):
    return adapters.table(spark, d, name).select(C("doc_id").cast("string").alias("item")).filter("item IS NOT NULL")


def _config(spark, d, layout):
    return bloom.Config.for_keys(layout, max(1, _ids(spark, d, "labels").count()), _BITS)


@query("SELECT CAST(doc_id AS VARCHAR) AS item FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def bloom_semi_join(spark, d):
    return bloom.semi_join(_ids(spark, d, "documents"), _ids(spark, d, "labels"), _config(spark, d, "blocked512"))


@query()
def bloom_build(spark, d):
    return bloom.build(_ids(spark, d, "labels"), _config(spark, d, "flat"))


@query()
def bloom_bit_count(spark, d):
    words = bloom.build(_ids(spark, d, "labels"), _config(spark, d, "flat"))
    return words.agg(F.sum(F.bit_count("bits")).cast("long").alias("bits"), F.count(F.lit(1)).alias("words"))


@query("SELECT count(*) AS members, 0 AS false_negatives FROM labels")
def bloom_query(spark, d):
    """Members that each layout misses, which must be none."""
    items = _ids(spark, d, "labels")
    missed = None
    for layout in bloom.LAYOUTS:
        c = _config(spark, d, layout)
        got = bloom.might_contain(items, bloom.build(items, c), c).select("item", (~C("hit")).alias("miss"))
        missed = got if missed is None else missed.unionByName(got)
    each = missed.groupBy("item").agg(F.max("miss").alias("miss"))
    return each.agg(F.count(F.lit(1)).alias("members"), F.count_if("miss").cast("int").alias("false_negatives"))


@query()
def bloom_hash(spark, d):
    rows = _ids(spark, d, "documents").withColumn("n", F.explode(F.array(*map(F.lit, range(4)))))
    return rows.select("item", "n", filter_hash("item", "n").alias("hash"))


_CONFIGS = [(layout, n, b) for layout in bloom.LAYOUTS for n in (1, 12, 100, 10000) for b in (1, 4, 10, 16)]


@query(f"""WITH v(layout, n, b) AS (VALUES {', '.join(f"('{layout}', {n}, {b})" for layout, n, b in _CONFIGS)}),
w AS (SELECT *, CASE WHEN layout = 'blocked512' THEN ((n * b + 63) // 64 + 7) // 8 * 8 ELSE (n * b + 63) // 64 END AS words FROM v)
SELECT layout, CAST(n AS BIGINT) AS n_keys, b AS bits, CAST(words AS BIGINT) AS words, CAST(ceil(words * 64 / n * ln(2)) AS INTEGER) AS hashes FROM w""")
def bloom_config(spark, d):
    rows = [(layout, n, b, c.words, c.hashes) for layout, n, b in _CONFIGS for c in [bloom.Config.for_keys(layout, n, float(b))]]
    return spark.createDataFrame(rows, "layout string, n_keys long, bits int, words long, hashes int")


@query("SELECT b AS bits_per_key, CAST(round(1000000 / pow(2, b * ln(2))) AS BIGINT) AS fpr_ppm FROM generate_series(1, 16) g(b)")
def expected_fpr(spark, d):
    return spark.range(1, 17).select(C("id").alias("bits_per_key"), F.round(1000000 / F.pow(F.lit(2.0), C("id") * F.log(F.lit(2.0)))).cast("long").alias("fpr_ppm"))


@query("SELECT min(i) AS first_missing FROM (SELECT unnest(generate_series(0, (SELECT max(doc_id) + 1 FROM labels))) AS i) WHERE i NOT IN (SELECT doc_id FROM labels)")
def bitset_first_missing(spark, d):
    """The least id whose successor is absent; no id is below it that isn't there."""
    ids = adapters.table(spark, d, "labels").select(C("doc_id").alias("i")).filter("i >= 0").distinct()
    after = ids.select((C("i") + 1).alias("i")).unionByName(spark.range(1).select(C("id").alias("i")))
    return after.join(ids, "i", "left_anti").agg(F.min("i").alias("first_missing"))
