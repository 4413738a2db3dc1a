"""Queries over the page graph, reference counts and interval maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotframe.operators import graph, intervals
from slotframe.operators.staging import stage
from slotframe.plans.register import query
from slotframe.plans.sql import EDGES, RUNS, UPDATES, node
from slotframe.sources import adapters

C = F.col
#: The roots of the traversals are the open orders, the new pages of a job all orders that aren't finished; finished
#: ones are deleted, and customers in debt lose their root.
OPEN, NEW, DELETED, DEBT = "o_orderstatus = 'O'", "o_orderstatus <> 'F'", "o_orderstatus = 'F'", "c_acctbal < 0"


def _pages(spark, d, kind, key, condition=None):
    rows = adapters.table(spark, d, {"orders": "orders", "customer": "customer", "supplier": "supplier", "part": "part"}[kind])
    return (rows.filter(condition) if condition else rows).select(adapters.node(kind, key).alias("page_id"))


def _kept_edges(spark, d):
    """The edges, written once, as every step of a traversal reads them."""
    return stage(adapters.edges(spark, d))


def _roots(spark, d):
    return _pages(spark, d, "orders", "o_orderkey", OPEN)


_REACH = f"""RECURSIVE {EDGES}, reach AS (SELECT {node(5, 'o_orderkey')} AS page_id FROM orders WHERE {OPEN}
UNION SELECT dst FROM reach JOIN edges ON src = page_id)"""


@query(f"WITH {EDGES} SELECT src, dst FROM edges WHERE src IN (SELECT {node(5, 'o_orderkey')} FROM orders WHERE {OPEN})")
def trace_refs(spark, d):
    return graph.out_refs(adapters.edges(spark, d), _roots(spark, d)).select("src", "dst")


@query(f"WITH {_REACH} SELECT src, dst FROM edges WHERE src IN (SELECT page_id FROM reach)")
def trace_refs_recursive(spark, d):
    return graph.trace(_kept_edges(spark, d), _roots(spark, d)).select("src", "dst")


@query(f"WITH {_REACH} SELECT page_id FROM reach")
def reachable_pages(spark, d):
    return graph.reach(_kept_edges(spark, d), _roots(spark, d)).select("page_id")


@query(f"WITH {EDGES} SELECT {node(6, 'p_partkey')} AS page_id FROM part UNION ALL SELECT {node(1, 'r_regionkey')} FROM region")
def caching_tracer(spark, d):
    pages = _pages(spark, d, "part", "p_partkey").unionByName(adapters.table(spark, d, "region").select(adapters.node("region", "r_regionkey").alias("page_id")))
    every = pages.unionByName(_pages(spark, d, "orders", "o_orderkey")).unionByName(_pages(spark, d, "customer", "c_custkey"))
    return graph.leaves(every, adapters.edges(spark, d))


@query(f"""WITH {EDGES} SELECT o_orderkey AS request, count(dst) AS refs FROM (SELECT DISTINCT o_orderkey * 3 AS o_orderkey FROM orders) LEFT JOIN edges ON src = {node(5, 'o_orderkey')} GROUP BY 1""")
def loading_tracer(spark, d):
    wanted = adapters.table(spark, d, "orders").select((C("o_orderkey") * 3).alias("request")).distinct()
    met = wanted.withColumn("src", adapters.node("orders", C("request"))).join(adapters.edges(spark, d), "src", "left")
    return met.groupBy("request").agg(F.count("dst").alias("refs"))


@query(f"""WITH {_REACH} SELECT page_id FROM (SELECT {node(3, 'c_custkey')} AS page_id FROM customer UNION ALL SELECT {node(6, 'p_partkey')} FROM part) WHERE page_id NOT IN (SELECT page_id FROM reach)""")
def prune_job(spark, d):
    new = _pages(spark, d, "customer", "c_custkey").unionByName(_pages(spark, d, "part", "p_partkey"))
    return graph.unreachable(new, _roots(spark, d), _kept_edges(spark, d))


_DELTA = f"""RECURSIVE {EDGES}, np AS (SELECT {node(5, 'o_orderkey')} AS page_id FROM orders WHERE {NEW}),
nr AS (SELECT {node(5, 'o_orderkey')} AS page_id FROM orders WHERE {OPEN}), orr AS (SELECT {node(3, 'c_custkey')} AS page_id FROM customer WHERE {DEBT}),
del AS (SELECT {node(5, 'o_orderkey')} AS page_id FROM orders WHERE {DELETED}),
reach AS (SELECT page_id FROM nr UNION SELECT dst FROM reach JOIN edges ON src = page_id), live AS (SELECT page_id FROM np WHERE page_id IN (SELECT page_id FROM reach)),
s AS (SELECT page_id, 1 AS d FROM live UNION ALL SELECT page_id, 1 FROM nr UNION ALL SELECT page_id, -1 FROM orr
UNION ALL SELECT dst, 1 FROM edges WHERE src IN (SELECT page_id FROM live) UNION ALL SELECT dst, -1 FROM edges WHERE src IN (SELECT page_id FROM del)),
delta AS (SELECT page_id, CAST(sum(d) AS BIGINT) AS delta FROM s WHERE page_id NOT IN (SELECT page_id FROM del) GROUP BY 1 HAVING sum(d) <> 0 UNION ALL SELECT page_id, -2147483648 FROM del)"""


def _deltas(spark, d):
    return graph.deltas(
        _pages(spark, d, "orders", "o_orderkey", NEW),
        _pages(spark, d, "orders", "o_orderkey", OPEN),
        _pages(spark, d, "customer", "c_custkey", DEBT),
        _pages(spark, d, "orders", "o_orderkey", DELETED),
        _kept_edges(spark, d),
    )


def _old_counts(spark, d):
    """A page's references and one more, as collected pages have."""
    return adapters.edges(spark, d).groupBy(C("dst").alias("page_id")).agg((F.count(F.lit(1)) + 1).alias("old"))


_OLD = "old AS (SELECT dst AS page_id, count(*) + 1 AS old FROM edges GROUP BY 1)"


@query(f"WITH {_DELTA} SELECT page_id >> 56 AS device, page_id, delta FROM delta")
def refcount_delta(spark, d):
    return _deltas(spark, d).select(F.shiftright("page_id", 56).alias("device"), "page_id", "delta")


@query(f"WITH {_DELTA}, {_OLD} SELECT page_id, coalesce(old, CASE WHEN delta = -2147483648 THEN 1 ELSE 0 END) AS old, delta, CASE WHEN delta = -2147483648 THEN 0 ELSE coalesce(old, 0) + delta END AS new FROM delta LEFT JOIN old USING (page_id)")
def refcount_apply(spark, d):
    met = _deltas(spark, d).join(_old_counts(spark, d), "page_id", "left")
    old = F.coalesce("old", F.when(C("delta") == graph.DROP, 1).otherwise(0)).cast("long")
    return met.select("page_id", old.alias("old"), "delta").withColumn("new", graph.apply_delta(C("old"), C("delta")))


@query("""WITH u AS (SELECT o_orderkey AS page_id, o_orderkey % 5 AS old, CASE WHEN o_orderkey % 7 = 0 THEN -2147483648 ELSE o_orderkey % 6 - 3 END AS delta FROM orders),
n AS (SELECT *, CASE WHEN delta = -2147483648 THEN 0 ELSE old + delta END AS new FROM u),
c AS (SELECT page_id, CASE WHEN new < 0 THEN 'negative' WHEN delta = -2147483648 AND old <> 1 THEN 'dropped_while_used' WHEN new = 0 AND delta <> -2147483648 AND old > 0 THEN 'zero_without_drop'
WHEN old = 1 AND new <> 0 THEN 'revived' WHEN old = 0 AND new = 1 THEN 'first_below_two' END AS code FROM n) SELECT page_id, code FROM c WHERE code IS NOT NULL""")
def refcount_invariants(spark, d):
    k = C("o_orderkey")
    rows = adapters.table(spark, d, "orders").select(k.alias("page_id"), (k % 5).alias("old"), F.when(k % 7 == 0, graph.DROP).otherwise(k % 6 - 3).cast("long").alias("delta"))
    return graph.violations(rows)


@query(f"WITH {EDGES}, r AS (SELECT dst, count(*) AS n FROM edges GROUP BY 1) SELECT {node(3, 'c_custkey')} AS page_id, 2 + coalesce(n, 0) AS ref_count FROM customer LEFT JOIN r ON dst = {node(3, 'c_custkey')}")
def refcount_init(spark, d):
    refs = adapters.edges(spark, d).groupBy(C("dst").alias("page_id")).agg(F.count(F.lit(1)).alias("n"))
    return _pages(spark, d, "customer", "c_custkey").join(refs, "page_id", "left").select("page_id", (F.coalesce("n", F.lit(0)) + 2).alias("ref_count"))


@query(f"WITH {EDGES} SELECT dst AS page_id, count(*) AS ref_count FROM edges GROUP BY 1")
def refcount_snapshot(spark, d):
    return adapters.edges(spark, d).groupBy(C("dst").alias("page_id")).agg(F.count(F.lit(1)).alias("ref_count"))


@query("SELECT o_custkey AS page_id, max_by(o_orderkey % 5, o_orderkey) AS ref_count, max(o_orderkey) AS learned FROM orders GROUP BY 1")
def allocator_replay(spark, d):
    """Log rows carry absolute counts, so the last one of a page wins."""
    rows = adapters.table(spark, d, "orders")
    return rows.groupBy(C("o_custkey").alias("page_id")).agg(F.max_by(C("o_orderkey") % 5, "o_orderkey").alias("ref_count"), F.max("o_orderkey").alias("learned"))


@query("""WITH c AS (SELECT o_custkey, o_orderkey % 4 AS n, lag(o_orderkey % 4) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders)
SELECT CAST(count_if(coalesce(before, 0) = 0 AND n >= 2) AS BIGINT) AS allocated, CAST(count_if(before > 0 AND n = 0) AS BIGINT) AS freed FROM c""")
def metrics_alloc_free(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    rows = adapters.table(spark, d, "orders").select("o_custkey", "o_orderkey", (C("o_orderkey") % 4).alias("n")).withColumn("before", F.lag("n").over(w))
    return rows.agg(F.count_if((F.coalesce("before", F.lit(0)) == 0) & (C("n") >= 2)).alias("allocated"), F.count_if((C("before") > 0) & (C("n") == 0)).alias("freed"))


@query("""WITH st AS (SELECT c_custkey AS page_id, c_custkey % 3 AS ref_count, c_nationkey AS user_index FROM customer), dl AS (SELECT DISTINCT o_custkey AS page_id, CAST(o_custkey % 25 AS INTEGER) AS user_index FROM orders)
SELECT page_id FROM st JOIN dl USING (page_id, user_index) WHERE ref_count = 1""")
def dead_page_join(spark, d):
    state = adapters.table(spark, d, "customer").select(C("c_custkey").alias("page_id"), (C("c_custkey") % 3).alias("ref_count"), C("c_nationkey").alias("user_index"))
    touched = adapters.table(spark, d, "orders").select(C("o_custkey").alias("page_id"), (C("o_custkey") % 25).cast("int").alias("user_index")).distinct()
    return state.filter("ref_count = 1").join(touched, ["page_id", "user_index"]).select("page_id")


@query("SELECT o_orderkey AS page_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def new_vs_existing(spark, d):
    base = adapters.table(spark, d, "lineitem").filter("l_quantity > 45").select(C("l_orderkey").alias("page_id"))
    return adapters.table(spark, d, "orders").select(C("o_orderkey").alias("page_id")).join(base, "page_id", "left_anti")


@query("SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'O' UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0 EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def id_sets(spark, d):
    orders, customers = adapters.table(spark, d, "orders"), adapters.table(spark, d, "customer")
    of = lambda s: orders.filter(C("o_orderstatus") == s).select(C("o_custkey").alias("id"))
    return of("O").unionByName(customers.filter("c_acctbal < 0").select(C("c_custkey").alias("id"))).distinct().join(of("P"), "id", "left_anti")


_DEAD = f"{node(5, 'o_orderkey')} FROM orders WHERE o_custkey % 3 = 0 OR o_orderkey % 2 = 0"


@query(f"""WITH {EDGES}, refs AS (SELECT dst, count(*) AS n FROM edges GROUP BY 1), d0 AS (SELECT {_DEAD.replace(' FROM', ' AS page_id FROM', 1)}),
d1 AS (SELECT dst AS page_id FROM edges WHERE src IN (SELECT page_id FROM d0) GROUP BY 1 HAVING count(*) >= (SELECT n FROM refs r WHERE r.dst = edges.dst)),
d2 AS (SELECT dst AS page_id FROM edges WHERE src IN (SELECT page_id FROM d0 UNION SELECT page_id FROM d1) AND dst NOT IN (SELECT page_id FROM d1) GROUP BY 1 HAVING count(*) >= (SELECT n FROM refs r WHERE r.dst = edges.dst)),
d3 AS (SELECT dst AS page_id FROM edges WHERE src IN (SELECT page_id FROM d0 UNION SELECT page_id FROM d1 UNION SELECT page_id FROM d2) AND dst NOT IN (SELECT page_id FROM d1 UNION SELECT page_id FROM d2) GROUP BY 1 HAVING count(*) >= (SELECT n FROM refs r WHERE r.dst = edges.dst))
SELECT page_id, 0 AS depth FROM d0 UNION ALL SELECT page_id, 1 FROM d1 UNION ALL SELECT page_id, 2 FROM d2 UNION ALL SELECT page_id, 3 FROM d3""")
def recycle_cascade(spark, d):
    edges = _kept_edges(spark, d)
    counts = edges.groupBy(C("dst").alias("page_id")).agg(F.count(F.lit(1)).alias("refs"))
    return graph.cascade(counts, _pages(spark, d, "orders", "o_orderkey", "o_custkey % 3 = 0 OR o_orderkey % 2 = 0"), edges).select("page_id", "depth")


# ---- intervals


@query(f"WITH {RUNS} SELECT map_key, lo, hi, slot FROM runs")
def interval_map_update(spark, d):
    return intervals.runs(adapters.interval_updates(spark, d)).select("map_key", "lo", "hi", "slot")


@query(f"""WITH {RUNS} SELECT k.map_key, g."at", coalesce(x.slot, 0) AS slot FROM (SELECT DISTINCT map_key FROM dense) k CROSS JOIN generate_series(0, 28) AS g("at") LEFT JOIN dense x ON x.map_key = k.map_key AND x."at" = g."at" WHERE true""")
def interval_map_to_vec(spark, d):
    return intervals.dense(intervals.runs(adapters.interval_updates(spark, d)), 29)


@query(f"""WITH {RUNS}, q AS (SELECT DISTINCT user_id AS map_key, user_id % 20 AS q_lo, user_id % 20 + 5 AS q_hi FROM events)
SELECT map_key, q_lo, q_hi, greatest(lo, q_lo) AS lo, least(hi, q_hi) AS hi, slot FROM runs JOIN q USING (map_key) WHERE lo < q_hi AND q_lo < hi""")
def interval_lookup(spark, d):
    k = C("user_id")
    queries = adapters.table(spark, d, "events").select(k.alias("map_key"), (k % 20).alias("q_lo"), (k % 20 + 5).alias("q_hi")).distinct()
    return intervals.lookup(intervals.runs(adapters.interval_updates(spark, d)), queries)


_PAIRS = "p AS (SELECT o_orderkey AS id, o_orderkey % 40 AS a, o_orderkey % 40 + o_orderkey % 9 AS b, o_custkey % 40 AS c, o_custkey % 40 + o_custkey % 11 AS d FROM orders)"


def _pairs(spark, d):
    k, c = C("o_orderkey"), C("o_custkey")
    return adapters.table(spark, d, "orders").select(k.alias("id"), (k % 40).alias("a"), (k % 40 + k % 9).alias("b"), (c % 40).alias("c"), (c % 40 + c % 11).alias("d"))


@query(f"WITH {_PAIRS} SELECT id, greatest(a, c) AS lo, least(b, d) AS hi FROM p WHERE greatest(a, c) < least(b, d)")
def interval_intersect(spark, d):
    return _pairs(spark, d).select("id", intervals.intersect(C("a"), C("b"), C("c"), C("d")).alias("x")).filter("x IS NOT NULL").select("id", "x.lo", "x.hi")


@query(f"""WITH {_PAIRS}, x AS (SELECT id, a AS lo, CASE WHEN c >= d OR d <= a OR b <= c THEN b ELSE least(b, c) END AS hi FROM p
UNION ALL SELECT id, greatest(a, d), b FROM p WHERE NOT (c >= d OR d <= a OR b <= c)) SELECT id, lo, hi FROM x WHERE lo < hi""")
def interval_without(spark, d):
    return _pairs(spark, d).select("id", F.explode(intervals.without(C("a"), C("b"), C("c"), C("d"))).alias("x")).select("id", "x.lo", "x.hi")


@query(f"WITH {_PAIRS} SELECT id, a >= b AS empty, greatest(b - a, 0) AS size FROM p")
def interval_empty(spark, d):
    return _pairs(spark, d).select("id", intervals.is_empty(C("a"), C("b")).alias("empty"), F.greatest(C("b") - C("a"), F.lit(0)).alias("size"))


@query(f"WITH {UPDATES} SELECT map_key, min(lo) AS lo, max(hi) AS hi FROM upd GROUP BY 1")
def merge_slot_ranges(spark, d):
    return intervals.hull(adapters.interval_updates(spark, d), "map_key")
