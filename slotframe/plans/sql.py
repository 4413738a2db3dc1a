"""SQL for the tables that adapters make, shared by the reference statements."""

EV = """ev AS (SELECT event_id AS seq, user_id, event_type, props,
  CASE event_type WHEN 'view' THEN 'raw' WHEN 'signup' THEN 'prepare' WHEN 'purchase' THEN 'commit' WHEN 'error' THEN 'rollback' WHEN 'click' THEN 'attach' END AS kind,
  CASE event_type WHEN 'view' THEN 8 WHEN 'signup' THEN 4 WHEN 'purchase' THEN 5 WHEN 'error' THEN 6 WHEN 'click' THEN 1 END AS kind_tag,
  CAST(1 + octet_length(encode(props)) AS BIGINT) AS body_size FROM events)"""


def varint(n: str) -> str:
    """Bytes of the varint of a value that isn't negative."""
    return "CAST(CASE " + " ".join(f"WHEN {n} < {1 << 7 * k} THEN {k}" for k in range(1, 9)) + " ELSE 9 END AS BIGINT)"


FRAMED = f"""{EV}, framed AS (SELECT seq, kind, kind_tag, user_id, props, body_size, header_size,
  CAST(sum(header_size + body_size) OVER (ORDER BY seq) AS BIGINT) AS slot_upper,
  CAST(sum(header_size + body_size) OVER (ORDER BY seq) - header_size - body_size AS BIGINT) AS slot_lower
  FROM (SELECT *, {varint('body_size')} AS header_size FROM ev))"""
BOUNDED = f"""{FRAMED}, b AS (SELECT max(slot_upper) * 25 // 100 AS trim_pos, max(slot_upper) * 75 // 100 AS flush_pos, max(slot_upper) AS commit_pos FROM framed)"""
JOBS = f"""{EV}, jobs AS (SELECT seq, kind, user_id, prepare_slot FROM (SELECT *,
  last_value(CASE WHEN kind = 'prepare' THEN seq END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prepare_slot
  FROM ev WHERE kind IN ('prepare', 'commit', 'rollback')) WHERE prepare_slot IS NOT NULL)"""
PENDING = f"""{JOBS}, pending AS (SELECT prepare_slot, user_id FROM jobs p WHERE kind = 'prepare'
  AND NOT EXISTS (SELECT 1 FROM jobs r WHERE r.kind <> 'prepare' AND r.prepare_slot = p.prepare_slot))"""


def node(device: int, key: str) -> str:
    return f"(({device}::BIGINT << 56) | {key}::BIGINT)"


EDGES = f"""edges AS (SELECT {node(2, 'n_nationkey')} AS src, {node(1, 'n_regionkey')} AS dst FROM nation
  UNION ALL SELECT {node(3, 'c_custkey')}, {node(2, 'c_nationkey')} FROM customer
  UNION ALL SELECT {node(4, 's_suppkey')}, {node(2, 's_nationkey')} FROM supplier
  UNION ALL SELECT {node(5, 'o_orderkey')}, {node(3, 'o_custkey')} FROM orders
  UNION ALL (SELECT DISTINCT {node(5, 'l_orderkey')}, {node(6, 'l_partkey')} FROM lineitem)
  UNION ALL (SELECT DISTINCT {node(5, 'l_orderkey')}, {node(4, 'l_suppkey')} FROM lineitem))"""
UPDATES = """upd AS (SELECT user_id AS map_key, event_id % 29 AS lo, event_id % 29 + 1 + event_id % (29 - event_id % 29) AS hi, event_id AS slot FROM events)"""
DENSE = f"""{UPDATES}, dense AS (SELECT map_key, "at", max(slot) AS slot FROM upd, generate_series(0, 28) AS g("at") WHERE lo <= "at" AND "at" < hi GROUP BY map_key, "at")"""
RUNS = f"""{DENSE}, runs AS (SELECT map_key, min("at") AS lo, max("at") + 1 AS hi, slot FROM (SELECT *, sum(new) OVER (PARTITION BY map_key ORDER BY "at") AS run FROM
  (SELECT *, CASE WHEN lag(slot) OVER w = slot AND lag("at") OVER w = "at" - 1 THEN 0 ELSE 1 END AS new FROM dense WINDOW w AS (PARTITION BY map_key ORDER BY "at"))) GROUP BY map_key, run, slot)"""
RECYCLE = """rec AS (SELECT o_orderkey % 997 AS page_id, CAST(o_orderkey % 7 AS INTEGER) AS depth, o_orderkey AS slot,
  CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 40 - o_orderkey % 5 END AS batch_slot, o_orderkey // 50 AS trim_slot, o_orderkey % 50 AS page_index FROM orders),
  lat AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY slot DESC) AS rn FROM rec) WHERE rn = 1)"""
HEADERS = f"""hdr AS (SELECT ((5::BIGINT << 56) | ((o_orderkey % 8) << 32) | o_orderkey) AS page_id, o_orderkey % 11 = 0 AS bad_magic,
  CASE WHEN o_orderkey % 13 = 0 THEN 8192 ELSE 4096 END AS size,
  CASE WHEN o_orderkey % 17 = 0 THEN 5000 ELSE o_orderkey % 2048 + 64 END AS unused_begin,
  CASE WHEN o_orderkey % 19 = 0 THEN 5001 WHEN o_orderkey % 17 = 0 THEN 6000 WHEN o_orderkey % 23 = 0 THEN 10 ELSE 4096 END AS unused_end,
  o_orderkey % 29 = 0 AS bad_generation, o_orderkey % 31 = 0 AS bad_address, o_orderstatus AS layout_id FROM orders)"""
