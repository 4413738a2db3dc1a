"""Queries over the log: scans, bounds, demultiplexing, jobs, attachments, recycling, trimming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotframe.functions import packed
from slotframe.functions.names import EVENT_KINDS, TAGS
from slotframe.operators import jobs, log, recycle
from slotframe.plans.register import query
from slotframe.plans.sql import BOUNDED, EV, FRAMED, HEADERS, JOBS, PENDING, RECYCLE, varint
from slotframe.sources import adapters, raw_log
from slotframe.streaming import tail

C = F.col


def _framed(spark: SparkSession, d: str) -> DataFrame:
    return log.frame(adapters.log(spark, d))


def _bounded(spark: SparkSession, d: str) -> DataFrame:
    return log.with_bounds(_framed(spark, d), adapters.log(spark, d))


def _job_log(spark: SparkSession, d: str) -> DataFrame:
    return adapters.log(spark, d, "prepare", "commit", "rollback")


def _durable_users(spark: SparkSession, d: str) -> DataFrame:
    return log.user_slots(log.visible(_bounded(spark, d), "durable"))


# ---- scans


@query(f"WITH {FRAMED} SELECT seq, kind, slot_lower, slot_upper, body_size, header_size FROM framed")
def log_scan(spark, d):
    return _framed(spark, d).select("seq", "kind", "slot_lower", "slot_upper", "body_size", "header_size")


@query(f"WITH {FRAMED} SELECT slot_lower, slot_upper, header_size, CAST(kind_tag AS INTEGER) AS kind_tag, props AS payload FROM framed")
def log_scan_bytes(spark, d):
    """The log packed into bytes and parsed again."""
    return raw_log.parse(raw_log.pack(_framed(spark, d))).withColumn("payload", C("payload").cast("string"))


@query(f"WITH {EV} SELECT seq, kind, kind_tag, body_size FROM ev")
def log_scan_blocking(spark, d):
    return tail.drain(tail.tail_scan(spark, f"{d}/events.parquet")).select("seq", "kind", "kind_tag", "body_size")


@query(f"WITH {FRAMED} SELECT seq, slot_lower, slot_lower + header_size AS body_at, slot_upper, header_size FROM framed")
def slot_frame(spark, d):
    return _framed(spark, d).select("seq", "slot_lower", (C("slot_lower") + C("header_size")).alias("body_at"), "slot_upper", "header_size")


@query(f"""WITH {EV}, e AS (SELECT seq, CASE WHEN seq % 10 = 0 THEN 0 ELSE body_size END AS body_size FROM ev),
f AS (SELECT seq, body_size, CAST(sum(body_size + {varint('body_size')}) OVER (ORDER BY seq) AS BIGINT) AS slot_upper FROM e)
SELECT seq, body_size, slot_upper FROM f WHERE body_size > 0""")
def skip_empty_slots(spark, d):
    some = adapters.log(spark, d).withColumn("body_size", F.when(C("seq") % 10 == 0, 0).otherwise(C("body_size")).cast("long"))
    return log.non_empty(log.frame(some)).select("seq", "body_size", "slot_upper")


@query(f"WITH {BOUNDED} SELECT seq, slot_lower FROM framed, b WHERE slot_lower < flush_pos")
def pre_slot_limit(spark, d):
    return log.before(_bounded(spark, d), C("flush_pos")).select("seq", "slot_lower")


@query(f"""WITH {BOUNDED} SELECT mode, CAST(count(*) AS BIGINT) AS n_slots, max(slot_upper) AS upper_bound FROM framed, b, (VALUES ('durable'), ('speculative'), ('inconsistent')) m(mode)
WHERE slot_upper <= CASE mode WHEN 'durable' THEN flush_pos ELSE commit_pos END GROUP BY mode""")
def read_mode(spark, d):
    slots = _bounded(spark, d)
    each = [log.visible(slots, m).agg(F.count(F.lit(1)).alias("n_slots"), F.max("slot_upper").alias("upper_bound")).select(F.lit(m).alias("mode"), "n_slots", "upper_bound") for m in ("durable", "speculative", "inconsistent")]
    return each[0].unionByName(each[1]).unionByName(each[2])


@query(f"WITH {BOUNDED} SELECT seq, slot_lower, slot_upper FROM framed, b WHERE slot_lower >= trim_pos AND slot_upper <= flush_pos")
def range_scan(spark, d):
    return log.in_range(_bounded(spark, d), C("trim_pos"), C("flush_pos")).select("seq", "slot_lower", "slot_upper")


@query(f"WITH {EV} SELECT kind_tag, kind, count(*) AS n, CAST(sum(body_size) AS BIGINT) AS bytes FROM ev GROUP BY 1, 2")
def typed_scan(spark, d):
    return log.by_kind(adapters.log(spark, d))


@query(f"WITH {FRAMED} SELECT seq, kind, slot_lower FROM framed WHERE kind IN ('raw', 'commit') ORDER BY slot_lower LIMIT 1")
def visit_next(spark, d):
    return log.first_slot(log.user_slots(_framed(spark, d))).select("seq", "kind", "slot_lower")


@query(f"WITH {BOUNDED} SELECT count(*) AS n, max(slot_upper) AS visited_upper FROM framed, b WHERE kind IN ('raw', 'commit') AND slot_upper <= flush_pos")
def consume_slots(spark, d):
    return log.progress(_durable_users(spark, d))


@query(f"WITH {BOUNDED} SELECT kind_tag, kind, count(*) AS n, CAST(sum(body_size) AS BIGINT) AS bytes FROM framed, b WHERE kind IN ('raw', 'commit') AND slot_upper <= flush_pos GROUP BY 1, 2")
def typed_volume_read(spark, d):
    return log.by_kind(_durable_users(spark, d))


@query(f"WITH {BOUNDED} SELECT count(*) AS n, max(slot_upper) AS visited_upper FROM framed, b WHERE kind IN ('raw', 'commit') AND slot_lower >= trim_pos AND slot_upper <= flush_pos")
def raw_chunk_parse(spark, d):
    """The log's bytes, parsed back; a slot counts if all of it lies in the chunk."""
    tags = {tag: kind for kind, tag in adapters.KINDS.values()}
    kind = F.create_map(*(F.lit(x) for pair in tags.items() for x in pair))[C("kind_tag")]
    parsed = raw_log.parse(raw_log.pack(_framed(spark, d))).withColumn("kind", kind)
    bounded = log.with_bounds(parsed, adapters.log(spark, d))
    return log.progress(log.user_slots(log.in_range(bounded, C("trim_pos"), C("flush_pos"))))


_REQUESTS = ((1, "trim_pos", "flush_pos"), (2, "flush_pos", "trim_pos"), (3, "0", "trim_pos"), (4, "trim_pos", "commit_pos + 100"), (5, "flush_pos", "flush_pos"))


@query(f"""WITH {BOUNDED}, r AS ({' UNION ALL '.join(f'SELECT {i} AS id, CAST({lo} AS BIGINT) AS lo, CAST({hi} AS BIGINT) AS hi FROM b' for i, lo, hi in _REQUESTS)})
SELECT id, lo, hi, CASE WHEN hi < lo THEN 'kInvalidArgument' WHEN lo < trim_pos OR hi > commit_pos THEN 'kOutOfRange' ELSE 'kOk' END AS status,
CASE WHEN hi < lo OR lo < trim_pos OR hi > commit_pos THEN 0 ELSE hi - lo END AS n_bytes FROM r, b""")
def get_root_log_data(spark, d):
    b = log.bounds(adapters.log(spark, d))
    rows = b.select(F.explode(F.array(*(F.struct(F.lit(i).alias("id"), F.expr(lo).cast("long").alias("lo"), F.expr(hi).cast("long").alias("hi")) for i, lo, hi in _REQUESTS))).alias("r")).select("r.*")
    return log.read_bytes(rows, b.select(C("trim_pos").alias("locked"), C("commit_pos").alias("log_end")))


@query("SELECT o_orderkey AS request, ((3::BIGINT << 56) | o_custkey) AS page_id, c_name AS payload FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def page_scan(spark, d):
    pages = adapters.table(spark, d, "customer").select(adapters.node("customer", "c_custkey").alias("page_id"), C("c_name").alias("payload"))
    wanted = adapters.table(spark, d, "orders").select(C("o_orderkey").alias("request"), adapters.node("customer", "o_custkey").alias("page_id"))
    return wanted.join(pages, "page_id", "left").select("request", "page_id", "payload")


_CATALOG = "cat(block, tag, slot_i, n_slots, uuid) AS (VALUES " + ", ".join(f"({b}, {t}, {i}, {n}, '{u}')" for b, t, i, n, u in adapters.CATALOG) + ")"
_TAG_NAME = "CASE tag " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in TAGS.items()) + " ELSE 'UNKNOWN' END"


def _tag_name(tag):
    return F.coalesce(F.create_map(*(F.lit(x) for kv in TAGS.items() for x in kv))[tag], F.lit("UNKNOWN"))


def _config_slots(spark):
    return adapters.catalog_blocks(spark).select("block", F.explode("slots").alias("s")).select("block", "s.tag", "s.slot_i", "s.n_slots", "s.uuid")


@query(f"WITH {_CATALOG} SELECT block, tag, slot_i, n_slots, uuid FROM cat")
def config_scan(spark, d):
    return _config_slots(spark)


@query(f"WITH {_CATALOG} SELECT {_TAG_NAME} AS tag_name, uuid FROM cat", name="list")
def list_slots(spark, d):
    return _config_slots(spark).select(_tag_name(C("tag")).alias("tag_name"), "uuid")


@query(f"WITH {_CATALOG} SELECT DISTINCT tag, {_TAG_NAME} AS tag_name FROM cat")
def tag_name(spark, d):
    return _config_slots(spark).select("tag", _tag_name(C("tag")).alias("tag_name")).distinct()


@query(f"WITH {_CATALOG} SELECT tag, slot_i, n_slots, uuid FROM cat WHERE uuid = '{adapters.CATALOG[1][4]}'")
def find_by_uuid(spark, d):
    return _config_slots(spark).filter(C("uuid") == adapters.CATALOG[1][4]).drop("block")


@query(f"WITH {_CATALOG} SELECT tag, slot_i, n_slots, uuid FROM cat WHERE tag = 4")
def find_by_tag(spark, d):
    return _config_slots(spark).filter("tag = 4").drop("block")


@query(f"""WITH {BOUNDED} SELECT trim_pos, flush_pos, commit_pos, commit_pos - trim_pos AS n_bytes, (SELECT count(*) FROM framed WHERE slot_lower >= trim_pos) AS n_slots FROM b""")
def snapshot(spark, d):
    kept = log.in_range(_bounded(spark, d), C("trim_pos"), None)
    return kept.groupBy("trim_pos", "flush_pos", "commit_pos").agg(F.count(F.lit(1)).alias("n_slots")).withColumn("n_bytes", C("commit_pos") - C("trim_pos"))


@query(f"WITH {BOUNDED} SELECT max(slot_upper) AS truncate_at FROM framed, b WHERE slot_upper <= commit_pos - 3")
def log_recovery_scan(spark, d):
    return log.in_range(_bounded(spark, d), None, C("commit_pos") - 3).agg(F.max("slot_upper").alias("truncate_at"))


# ---- appends


@query(f"""WITH {FRAMED} SELECT seq // 16 AS batch, count(*) AS n, min(slot_lower) AS lower, max(slot_upper) AS upper,
max(slot_upper) - min(slot_lower) = sum(slot_upper - slot_lower) AS contiguous FROM framed GROUP BY 1""")
def multi_append(spark, d):
    return log.batch_appends(adapters.log(spark, d), F.floor(C("seq") / 16))


@query(f"""WITH {FRAMED}, j AS (WITH {JOBS} SELECT * FROM jobs) SELECT p.prepare_slot, c.seq AS commit_slot, a.slot_lower AS prepare_lower, b.slot_upper AS commit_upper
FROM (SELECT * FROM j WHERE kind = 'prepare') p JOIN (SELECT * FROM j WHERE kind = 'commit') c USING (prepare_slot) JOIN framed a ON a.seq = p.prepare_slot JOIN framed b ON b.seq = c.seq""")
def job_append(spark, d):
    framed = _framed(spark, d)
    pairs = jobs.committed(jobs.linked(_job_log(spark, d)))
    low = framed.select(C("seq").alias("prepare_slot"), C("slot_lower").alias("prepare_lower"))
    high = framed.select(C("seq").alias("commit_slot"), C("slot_upper").alias("commit_upper"))
    return pairs.join(low, "prepare_slot").join(high, "commit_slot").select("prepare_slot", "commit_slot", "prepare_lower", "commit_upper")


@query(f"SELECT event_id, {varint('(1 + octet_length(encode(props)))')} + 1 + octet_length(encode(props)) AS grant_bytes FROM events")
def calculate_grant_size(spark, d):
    return adapters.table(spark, d, "events").select("event_id", packed.slot_packed_size(F.octet_length("props")).cast("long").alias("grant_bytes"))


@query(f"WITH {BOUNDED} SELECT count(*) AS n, min(slot_lower) AS lower, CAST(sum(slot_upper - slot_lower) AS BIGINT) AS bytes FROM framed, b WHERE slot_lower >= trim_pos")
def trim(spark, d):
    kept = log.in_range(_bounded(spark, d), C("trim_pos"), None)
    return kept.agg(F.count(F.lit(1)).alias("n"), F.min("slot_lower").alias("lower"), F.sum(C("slot_upper") - C("slot_lower")).alias("bytes"))


# ---- demultiplexing


@query(f"""WITH {BOUNDED} SELECT kind, count(*) AS n, min(slot_lower) AS first_lower, max(slot_upper) AS last_upper, CAST(sum(slot_upper - slot_lower) AS BIGINT) AS bytes
FROM framed, b WHERE kind IN ('raw', 'commit') AND slot_upper <= flush_pos GROUP BY kind""")
def user_slot_demux(spark, d):
    return _durable_users(spark, d).groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), F.min("slot_lower").alias("first_lower"), F.max("slot_upper").alias("last_upper"), F.sum(C("slot_upper") - C("slot_lower")).alias("bytes")
    )


@query(f"""WITH {JOBS}, s AS (SELECT seq, body_size + {varint('body_size')} AS size FROM ev)
SELECT c.seq AS commit_slot, c.prepare_slot, a.size + b.size AS "grant" FROM jobs c JOIN s a ON a.seq = c.prepare_slot JOIN s b ON b.seq = c.seq WHERE c.kind = 'commit'""")
def demux_commit_grant(spark, d):
    rows = adapters.log(spark, d)
    sizes = rows.select("seq", (C("body_size") + packed.varint_size(C("body_size"))).cast("long").alias("size"))
    return jobs.commit_grants(jobs.linked(_job_log(spark, d)), sizes)


@query(f"WITH {FRAMED} SELECT count(*) AS n, CAST(count_if(slot_upper <= before) AS BIGINT) AS violations FROM (SELECT slot_upper, lag(slot_upper) OVER (ORDER BY seq) AS before FROM framed)")
def monotone_check(spark, d):
    return log.monotone_violations(_framed(spark, d))


_KINDS = ", ".join(f"({i}, '{k}')" for i, k in enumerate(EVENT_KINDS))


@query(f"WITH {EV} SELECT t AS kind_tag, k AS kind, count(seq) AS n FROM (VALUES {_KINDS}) v(t, k) LEFT JOIN ev ON kind = k GROUP BY 1, 2")
def event_visitor(spark, d):
    return log.all_kinds(adapters.log(spark, d), EVENT_KINDS)


@query(f"WITH {HEADERS} SELECT page_id, CASE WHEN layout_id = 'F' THEN 'kOk' ELSE 'kPageHeaderBadLayoutId' END AS status FROM hdr")
def require_layout(spark, d):
    return log.require_layout(adapters.page_headers(spark, d), "F")


@query(f"""WITH {HEADERS} SELECT page_id, CASE WHEN bad_magic THEN 'kPageHeaderBadMagic' WHEN size <> 4096 THEN 'kPageHeaderBadPageSize' WHEN unused_begin > unused_end THEN 'kPageHeaderBadUnusedSize'
WHEN unused_begin > 4096 THEN 'kPageHeaderBadUnusedBegin' WHEN unused_end > 4096 THEN 'kPageHeaderBadUnusedEnd' WHEN bad_generation THEN 'kPageHeaderBadGeneration'
WHEN bad_address THEN 'kPageHeaderBadPageId' ELSE 'kOk' END AS status FROM hdr""")
def header_sanity(spark, d):
    return log.header_status(adapters.page_headers(spark, d), 4096)


# ---- jobs and attachments


@query(f"WITH {PENDING} SELECT prepare_slot, user_id FROM pending")
def job_pending(spark, d):
    return jobs.pending(jobs.linked(_job_log(spark, d)))


@query(f"WITH {JOBS} SELECT prepare_slot, seq AS commit_slot, seq - prepare_slot AS lag FROM jobs WHERE kind = 'commit'")
def job_committed(spark, d):
    return jobs.committed(jobs.linked(_job_log(spark, d)))


_RESOLVED = f"""{PENDING}, att AS (SELECT user_id % 7 AS device, max(seq) AS user_slot FROM ev WHERE kind = 'attach' AND seq < 9 * (SELECT max(seq) FROM ev) // 10 GROUP BY 1),
each AS (SELECT prepare_slot, user_id % 3 AS device FROM pending UNION ALL SELECT prepare_slot, user_id % 8 FROM pending),
resolved AS (SELECT prepare_slot, CASE WHEN bool_or(user_slot IS NULL) THEN 'fatal' WHEN bool_or(user_slot >= prepare_slot) THEN 'commit' ELSE 'rollback' END AS decision
FROM each LEFT JOIN att USING (device) GROUP BY 1)"""


@query(f"WITH {_RESOLVED} SELECT prepare_slot, decision FROM resolved")
def job_resolution(spark, d):
    rows = adapters.log(spark, d)
    end = rows.agg(F.floor(9 * F.max("seq") / 10).alias("end"))
    attached = rows.filter("kind = 'attach'").crossJoin(F.broadcast(end)).filter("seq < end").groupBy((C("user_id") % 7).alias("device")).agg(F.max("seq").alias("user_slot"))
    waiting = jobs.pending(jobs.linked(_job_log(spark, d))).select("prepare_slot", F.array(C("user_id") % 3, C("user_id") % 8).alias("devices"))
    return jobs.resolutions(waiting, attached)


@query(f"WITH {EV}, a AS (SELECT user_id, max(seq) AS user_slot FROM ev WHERE kind = 'attach' GROUP BY 1) SELECT c_custkey AS client, user_slot FROM customer JOIN a ON user_id = c_custkey")
def attachment_lookup(spark, d):
    attached = adapters.log(spark, d, "attach").groupBy(C("user_id").alias("client")).agg(F.max("seq").alias("user_slot"))
    return adapters.table(spark, d, "customer").select(C("c_custkey").alias("client")).join(attached, "client")


@query(f"WITH {EV} SELECT user_id AS client, max(seq) AS user_slot FROM ev WHERE kind IN ('attach', 'rollback') GROUP BY 1 HAVING max_by(kind, seq) = 'attach'")
def attachments(spark, d):
    rows = adapters.log(spark, d, "attach", "rollback")
    return jobs.attachments(rows.select(C("user_id").alias("client"), C("seq").alias("slot"), F.when(C("kind") == "attach", "attach").otherwise("detach").alias("kind")))


_UPDATES_SQL = "u AS (SELECT event_id AS arrival, user_id AS client, event_id - event_id % 7 * 40 AS user_slot, user_id % 10 <> 3 AS attached FROM events)"


def _updates(spark, d):
    k = C("event_id")
    return adapters.table(spark, d, "events").select(k.alias("arrival"), C("user_id").alias("client"), (k - k % 7 * 40).alias("user_slot"), (C("user_id") % 10 != 3).alias("attached"))


@query(f"""WITH {_UPDATES_SQL}, m AS (SELECT *, max(CASE WHEN attached THEN user_slot END) OVER (PARTITION BY client ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM u)
SELECT arrival, client, user_slot, CASE WHEN NOT attached THEN 'not_attached' WHEN last IS NULL OR last < user_slot THEN 'applied' ELSE 'no_change' END AS status FROM m""")
def exactly_once(spark, d):
    return jobs.exactly_once(_updates(spark, d))


@query("""WITH u AS (SELECT event_id AS arrival, user_id AS client, event_id - event_id % 7 * 40 + 1000 AS user_slot FROM events),
m AS (SELECT *, max(user_slot) OVER (PARTITION BY client ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM u)
SELECT arrival, client, user_slot FROM m WHERE last IS NULL OR last < user_slot""")
def exactly_once_stream(spark, d):
    k = C("event_id")
    stream = tail.event_stream(spark, f"{d}/events.parquet").select(k.alias("arrival"), C("user_id").alias("client"), (k - k % 7 * 40 + 1000).alias("user_slot"))
    return tail.drain(tail.exactly_once(stream))


@query("""SELECT user_id AS key, max_by(props, event_id) AS value FROM events GROUP BY 1 HAVING max_by(event_type, event_id) <> 'error'""")
def kv_replay(spark, d):
    return jobs.kv_replay(adapters.kv_events(spark, d))


@query("""SELECT user_id AS key, max_by(props, event_id) AS value FROM events GROUP BY 1 HAVING max_by(event_type, event_id) <> 'error'""")
def kv_replay_stream(spark, d):
    op = F.when(C("event_type") == "error", "remove").otherwise("upsert")
    events = tail.event_stream(spark, f"{d}/events.parquet").select(C("event_id").alias("seq"), op.alias("op"), C("user_id").alias("key"), C("props").alias("value"))
    return jobs.kv_replay(tail.drain(tail.kv_changes(events)))


@query(f"WITH {JOBS} SELECT user_id, prepare_slot, lag(prepare_slot) OVER (PARTITION BY user_id ORDER BY prepare_slot) AS prev_user_slot FROM jobs WHERE kind = 'prepare'")
def prev_user_slot(spark, d):
    return jobs.previous_user_slot(jobs.linked(_job_log(spark, d)))


@query(f"WITH {FRAMED} SELECT seq AS i, coalesce(lag(slot_upper) OVER (ORDER BY seq), 0) AS prev_upper, slot_upper AS upper FROM framed")
def sequence_chain(spark, d):
    return log.predecessor(_framed(spark, d), "seq", "slot_upper", "prev_upper", first=0).select(C("seq").alias("i"), "prev_upper", C("slot_upper").alias("upper"))


@query(f"""WITH {FRAMED}, s AS (SELECT min(slot_lower) AS base, max(slot_upper) AS upper FROM framed GROUP BY seq // 1000)
SELECT base, upper - base AS n_bytes, base - coalesce(lag(upper) OVER (ORDER BY base), 0) AS gap FROM s ORDER BY base""")
def sort_segments(spark, d):
    return log.sort_segments(raw_log.pack(_framed(spark, d)).select("base", F.octet_length("data").cast("long").alias("n_bytes")))


@query("""SELECT o_orderkey AS physical, o_orderkey % 8 AS generation FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_suppkey % 8 >= o_orderkey % 8)""")
def page_drop(spark, d):
    """Line items drop generations of their orders' pages, again and late."""
    pages = adapters.table(spark, d, "orders").select(C("o_orderkey").alias("physical"), (C("o_orderkey") % 8).alias("generation"))
    drops = adapters.table(spark, d, "lineitem").select(C("l_orderkey").alias("physical"), (C("l_suppkey") % 8).alias("generation"))
    return recycle.drop_pages(pages, drops)


# ---- trimming and recovery


@query(f"""WITH {BOUNDED}, gone AS (SELECT * FROM framed, b WHERE slot_lower < trim_pos AND slot_upper <= trim_pos)
SELECT count(*) AS n, max(slot_upper) AS region_upper, CAST(count_if(kind = 'commit') AS BIGINT) AS n_commits FROM gone""")
def trim_region(spark, d):
    gone = log.in_range(log.before(_bounded(spark, d), C("trim_pos")), None, C("trim_pos"))
    return gone.agg(F.count(F.lit(1)).alias("n"), F.max("slot_upper").alias("region_upper"), F.count_if(C("kind") == "commit").alias("n_commits"))


@query(f"""WITH {BOUNDED} SELECT r AS page_id, -count(*) AS delta FROM (SELECT unnest([user_id, user_id % 10 + 1000]) AS r FROM framed, b WHERE kind = 'commit' AND slot_upper <= trim_pos) GROUP BY 1""")
def trim_drop_roots(spark, d):
    gone = log.in_range(_bounded(spark, d), None, C("trim_pos")).filter("kind = 'commit'")
    roots = gone.select(F.explode(F.array(C("user_id"), C("user_id") % 10 + 1000)).alias("page_id"))
    return roots.groupBy("page_id").agg((-F.count(F.lit(1))).alias("delta"))


@query(f"WITH {BOUNDED} SELECT delay, greatest(flush_pos - delay, 0) AS target FROM b, (VALUES (0::BIGINT), (4096), (1::BIGINT << 40)) v(delay)")
def trim_delay(spark, d):
    delays = spark.createDataFrame([(0,), (4096,), (1 << 40,)], "delay long")
    return delays.crossJoin(F.broadcast(log.bounds(adapters.log(spark, d)))).select("delay", F.greatest(C("flush_pos") - C("delay"), F.lit(0)).alias("target"))


@query(f"""WITH {BOUNDED}, t AS (SELECT seq, slot_lower // 2 AS old_trim, slot_lower // 2 + 100 AS new_trim FROM framed WHERE kind = 'rollback')
SELECT seq, old_trim, new_trim FROM t WHERE seq = (SELECT max(seq) FROM t) AND (SELECT trim_pos FROM b) < new_trim""")
def pending_trim(spark, d):
    half = F.floor(C("slot_lower") / 2).cast("long")
    trims = _framed(spark, d).filter("kind = 'rollback'").select("seq", half.alias("old_trim"), (half + 100).alias("new_trim"))
    trimmed = log.bounds(adapters.log(spark, d)).select("trim_pos").scalar()
    return jobs.pending_trim(trims, trimmed)


@query(f"""WITH {EV}, m AS (SELECT user_id AS client, kind_tag % 2 AS part, max(seq) AS slot, count(*) AS copies FROM ev WHERE kind IN ('attach', 'rollback') GROUP BY 1, 2)
SELECT count(*) AS entries, CAST(count_if(copies > 1) AS BIGINT) AS seen_again, CAST(count_if(copies > 1) * 34 AS BIGINT) AS reclaimable_bytes, CAST(sum(slot) AS BIGINT) AS slot_sum FROM m""")
def metadata_latest(spark, d):
    rows = adapters.log(spark, d, "attach", "rollback")
    each = rows.groupBy(C("user_id").alias("client"), (C("kind_tag") % 2).alias("part")).agg(F.max("seq").alias("slot"), F.count(F.lit(1)).alias("copies"))
    again = F.count_if(C("copies") > 1)
    return each.agg(F.count(F.lit(1)).alias("entries"), again.alias("seen_again"), (again * 34).alias("reclaimable_bytes"), F.sum("slot").alias("slot_sum"))


@query(f"WITH {FRAMED} SELECT coalesce(min(CASE WHEN user_id % 50 = 7 AND kind = 'attach' THEN slot_lower END), max(slot_upper)) AS lower_bound FROM framed")
def locked_lower_bound(spark, d):
    held = (C("user_id") % 50 == 7) & (C("kind") == "attach")
    return jobs.locked_lower_bound(_framed(spark, d).select(C("slot_lower").alias("lower"), C("slot_upper").alias("upper"), held.alias("held")))


@query(f"""WITH {_RESOLVED} SELECT (SELECT count(*) FROM ev) AS slots, (SELECT count(*) FROM ev WHERE kind IN ('raw', 'commit')) AS user_slots,
(SELECT count(DISTINCT user_id) FROM ev WHERE kind = 'attach') AS attached, (SELECT count(*) FROM pending) AS pending_jobs,
CAST(count_if(decision = 'commit') AS BIGINT) AS to_commit, CAST(count_if(decision = 'rollback') AS BIGINT) AS to_roll_back, CAST(count_if(decision = 'fatal') AS BIGINT) AS fatal FROM resolved""")
def volume_recover(spark, d):
    """What a recovery finds, and what it decides for the jobs that nothing resolved."""
    rows = adapters.log(spark, d)
    user = C("kind").isin(*log.USER_KINDS)
    scan = rows.agg(F.count(F.lit(1)).alias("slots"), F.count_if(user).alias("user_slots"), F.countDistinct(F.when(C("kind") == "attach", C("user_id"))).alias("attached"))
    decided = job_resolution(spark, d).agg(F.count(F.lit(1)).alias("pending_jobs"), *(F.count_if(C("decision") == x).alias(name) for x, name in (("commit", "to_commit"), ("rollback", "to_roll_back"), ("fatal", "fatal"))))
    return scan.crossJoin(F.broadcast(decided))


@query(f"""WITH {FRAMED}, l AS (SELECT kind, slot_lower AS lower, lead(slot_lower) OVER (PARTITION BY user_id ORDER BY seq) AS released FROM framed WHERE kind IN ('attach', 'rollback')),
q AS (SELECT slot_lower AS "at", slot_upper AS target FROM framed WHERE kind = 'commit')
SELECT "at", target, least(target, coalesce(min(lower), target)) AS granted FROM q LEFT JOIN (SELECT * FROM l WHERE kind = 'attach') x ON lower <= "at" AND (released IS NULL OR released > "at") GROUP BY 1, 2""")
def trim_lock(spark, d):
    """An attach locks the log from its slot on, up to the user's next attach or rollback; each commit asks to trim up to its end."""
    slots = _framed(spark, d).withColumn("_back", -C("seq"))
    turns = log.predecessor(slots.filter(C("kind").isin("attach", "rollback")), "_back", "slot_lower", "released", keys=("user_id",))
    locks = turns.filter("kind = 'attach'").select(C("slot_lower").alias("lower"), "released")
    return jobs.trim_grants(locks, slots.filter("kind = 'commit'").select(C("slot_lower").alias("at"), C("slot_upper").alias("target")))


@query(f"""WITH {EV}, a AS (SELECT user_id AS client, min(seq) AS slot FROM ev WHERE kind = 'attach' GROUP BY 1)
SELECT client, slot, CASE WHEN row_number() OVER (ORDER BY slot) <= 100 THEN 'kOk' ELSE 'kOutOfAttachments' END AS status FROM a""")
def attachment_alloc(spark, d):
    """Clients that attach, in order, to an allocator with 100 places; which free place one gets isn't determined."""
    first = adapters.log(spark, d, "attach").groupBy(C("user_id").alias("client")).agg(F.min("seq").alias("slot"))
    return jobs.allocate(first, 100)


@query(f"""WITH {JOBS}, done AS (SELECT prepare_slot, min(seq) AS done_slot FROM jobs WHERE kind <> 'prepare' GROUP BY 1),
p AS (SELECT user_id, prepare_slot, lag(prepare_slot) OVER (PARTITION BY user_id ORDER BY prepare_slot) AS previous FROM jobs WHERE kind = 'prepare')
SELECT user_id, p.prepare_slot, previous, CASE WHEN b.done_slot IS NULL THEN 'previous_unresolved' ELSE 'previous_later' END AS code
FROM p JOIN done a ON a.prepare_slot = p.prepare_slot LEFT JOIN done b ON b.prepare_slot = previous WHERE previous IS NOT NULL AND (b.done_slot IS NULL OR b.done_slot > a.done_slot)""")
def job_pipeline(spark, d):
    return jobs.out_of_order(jobs.linked(_job_log(spark, d)))


@query("""WITH o AS (SELECT o_custkey AS page_id, max_by(o_orderkey % 5, o_orderkey) AS ref_count, max(o_orderkey) AS slot FROM orders GROUP BY 1),
e AS (SELECT max(o_orderkey) + 1 AS log_end, max(o_orderkey) // 2 AS trim_target FROM orders)
SELECT page_id, ref_count, slot AS old_slot, log_end + row_number() OVER (ORDER BY slot) - 1 AS new_slot FROM o, e WHERE slot < trim_target""")
def checkpoint_slice(spark, d):
    """The objects whose latest record keeps the log's older half are written again at its end."""
    rows = adapters.table(spark, d, "orders").select(C("o_custkey").alias("page_id"), (C("o_orderkey") % 5).alias("ref_count"), C("o_orderkey").alias("slot"))
    end = rows.agg((F.max("slot") + 1).alias("log_end"), F.floor(F.max("slot") / 2).alias("trim_target"))
    return recycle.checkpoint(rows, ["page_id"], end, "ref_count")


# ---- recycling


@query(f"WITH {RECYCLE} SELECT page_id, depth, slot FROM lat WHERE batch_slot IS NULL")
def recycle_pending(spark, d):
    return recycle.pending(adapters.recycle_rows(spark, d))


@query(f"WITH {RECYCLE}, p AS (SELECT * FROM lat WHERE batch_slot IS NULL) SELECT page_id, depth, slot FROM p WHERE depth = (SELECT max(depth) FROM p) ORDER BY slot DESC, page_id LIMIT 24")
def recycle_batch(spark, d):
    return recycle.batch(recycle.pending(adapters.recycle_rows(spark, d)))


_IN_FLIGHT = f"""WITH {RECYCLE}, t AS (SELECT * FROM lat WHERE batch_slot IS NOT NULL AND batch_slot NOT IN (0, 10, 20))
SELECT batch_slot, page_id, depth, min(depth) OVER (PARTITION BY batch_slot) <> max(depth) OVER (PARTITION BY batch_slot) AS mixed_depth FROM t"""


@query(_IN_FLIGHT)
def recycle_batch_recover(spark, d):
    done = spark.createDataFrame([(0,), (10,), (20,)], "batch_slot long")
    return recycle.in_flight(adapters.recycle_rows(spark, d), done)


@query(f"""WITH {RECYCLE} SELECT (SELECT count(*) FROM lat WHERE batch_slot IS NULL) AS pending, (SELECT count(*) FROM lat WHERE batch_slot IS NOT NULL AND batch_slot NOT IN (0, 10, 20)) AS in_flight,
(SELECT max(slot) FROM lat) AS last_slot""")
def recycler_recover(spark, d):
    done = C("batch_slot").isin(0, 10, 20)
    last = recycle.latest_state(adapters.recycle_rows(spark, d))
    return last.agg(F.count_if(C("batch_slot").isNull()).alias("pending"), F.count_if(C("batch_slot").isNotNull() & ~done).alias("in_flight"), F.max("slot").alias("last_slot"))


@query("""WITH r AS (SELECT o_orderkey AS arrival, o_custkey AS volume, (o_orderkey - o_orderkey % 3 * 30) // 50 AS trim_slot, o_orderkey % 50 AS page_index FROM orders),
m AS (SELECT *, max(trim_slot * 1000 + page_index) OVER (PARTITION BY volume ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM r)
SELECT arrival, volume, trim_slot, page_index FROM m WHERE best IS NULL OR trim_slot * 1000 + page_index > best""")
def recycler_dedupe(spark, d):
    k = C("o_orderkey")
    rows = adapters.table(spark, d, "orders").select(k.alias("arrival"), C("o_custkey").alias("volume"), F.expr("(o_orderkey - o_orderkey % 3 * 30) div 50").alias("trim_slot"), (k % 50).alias("page_index"))
    return recycle.accepted(rows)


# ---- totals


@query(f"WITH {BOUNDED} SELECT commit_pos - trim_pos AS size, (commit_pos * 2) - (commit_pos - trim_pos) AS space FROM b")
def log_size_space(spark, d):
    size = C("commit_pos") - C("trim_pos")
    return log.bounds(adapters.log(spark, d)).select(size.alias("size"), (C("commit_pos") * 2 - size).alias("space"))


@query("SELECT count(*) AS capacity, count(*) - CAST(count_if(o_orderstatus = 'F') AS BIGINT) AS in_use, (count(*) - CAST(count_if(o_orderstatus = 'F') AS BIGINT)) * 4096 AS bytes FROM orders")
def in_use(spark, d):
    used = F.count(F.lit(1)) - F.count_if(C("o_orderstatus") == "F")
    return adapters.table(spark, d, "orders").agg(F.count(F.lit(1)).alias("capacity"), used.alias("in_use"), (used * 4096).alias("bytes"))


@query(f"WITH {HEADERS} SELECT CAST(sum(size) AS BIGINT) AS bytes_written, CAST(sum(size - (unused_end - unused_begin)) AS BIGINT) AS used_bytes, CAST(sum(size // 4096) AS BIGINT) AS ops FROM hdr")
def used_bytes(spark, d):
    h = adapters.page_headers(spark, d)
    return h.agg(F.sum("size").alias("bytes_written"), F.sum(C("size") - (C("unused_end") - C("unused_begin"))).alias("used_bytes"), F.sum(F.floor(C("size") / 4096)).alias("ops"))


@query(f"WITH {BOUNDED} SELECT CAST((SELECT sum(slot_upper - slot_lower + 64) FROM framed) * 1000 // (SELECT flush_pos FROM b) AS BIGINT) AS ratio_x1000")
def write_amplification(spark, d):
    written = _bounded(spark, d).agg(F.sum(C("slot_upper") - C("slot_lower") + 64).alias("w"), F.max("flush_pos").alias("f"))
    return written.select(F.floor(C("w") * 1000 / C("f")).cast("long").alias("ratio_x1000"))


@query("SELECT CAST(floor(log2(octet_length(encode(text)))) AS INTEGER) AS size_log2, count(*) AS n FROM documents WHERE octet_length(encode(text)) > 0 GROUP BY 1")
def size_histogram(spark, d):
    n = F.octet_length("text")
    rows = adapters.table(spark, d, "documents").filter(n > 0)
    return rows.groupBy((F.length(F.bin(n.cast("long"))) - 1).alias("size_log2")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {JOBS}, t AS (SELECT event_id AS seq, epoch_us(ts) AS us FROM events)
SELECT kind, count(*) AS n, CAST(sum(b.us - a.us) AS BIGINT) AS total_us, min(b.us - a.us) AS min_us, max(b.us - a.us) AS max_us
FROM jobs j JOIN t a ON a.seq = j.prepare_slot JOIN t b ON b.seq = j.seq WHERE kind <> 'prepare' GROUP BY 1""")
def latency_metrics(spark, d):
    times = adapters.table(spark, d, "events").select(C("event_id").alias("seq"), F.unix_micros(C("ts").cast("timestamp")).alias("us"))
    return jobs.latencies(jobs.linked(_job_log(spark, d)), times)


@query("SELECT count(*) AS n, count(DISTINCT l_partkey) AS n_pages FROM lineitem")
def distinct(spark, d):
    pages = adapters.table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    return pages.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_pages"))


@query("SELECT max(event_id) AS tick, count(DISTINCT user_id) AS threads FROM events")
def lru_tick(spark, d):
    own = adapters.table(spark, d, "events").groupBy("user_id").agg(F.max("event_id").alias("tick"))
    return own.agg(F.max("tick").alias("tick"), F.count(F.lit(1)).alias("threads"))


@query("SELECT user_id, max(event_id) AS last_update FROM events GROUP BY 1 ORDER BY last_update")
def lru_order(spark, d):
    return adapters.table(spark, d, "events").groupBy("user_id").agg(F.max("event_id").alias("last_update")).orderBy("last_update")


@query("SELECT max(o_orderkey) AS allocated FROM orders WHERE o_orderstatus = 'F'")
def alloc_policy(spark, d):
    freed = adapters.table(spark, d, "orders").filter("o_orderstatus = 'F'")
    return freed.orderBy(F.desc("o_orderkey")).limit(1).select(C("o_orderkey").alias("allocated"))


@query("SELECT p_size % 8 AS size_log2, count(*) AS devices, min(p_partkey) AS first_device FROM part GROUP BY 1")
def devices_by_size(spark, d):
    return adapters.table(spark, d, "part").groupBy((C("p_size") % 8).alias("size_log2")).agg(F.count(F.lit(1)).alias("devices"), F.min("p_partkey").alias("first_device"))


@query(f"WITH {EV} SELECT seq, user_id FROM ev WHERE kind = 'attach' ORDER BY seq LIMIT 5")
def heap_key_order(spark, d):
    return adapters.log(spark, d, "attach").orderBy("seq").limit(5).select("seq", "user_id")
