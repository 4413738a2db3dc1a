"""Two-phase jobs, attachments and exactly-once updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotframe.operators.log import running


def linked(log: DataFrame) -> DataFrame:
    """Prepares, commits and rollbacks with prepare_slot: their own seq, or that of the user's latest prepare before."""
    own = F.when(F.col("kind") == "prepare", F.col("seq"))
    rows = log.filter(F.col("kind").isin("prepare", "commit", "rollback"))
    return running(rows, ("user_id",), "seq", own, "last", "prepare_slot").filter("prepare_slot IS NOT NULL")


def pending(jobs: DataFrame) -> DataFrame:
    """Prepares that nothing resolves."""
    resolved = jobs.filter(F.col("kind") != "prepare").select("prepare_slot")
    return jobs.filter(F.col("kind") == "prepare").join(resolved, "prepare_slot", "left_anti").select("prepare_slot", "user_id")


def committed(jobs: DataFrame) -> DataFrame:
    """prepare_slot, commit_slot and lag of each commit."""
    prepares = jobs.filter(F.col("kind") == "prepare").select("prepare_slot")
    commits = jobs.filter(F.col("kind") == "commit").select("prepare_slot", F.col("seq").alias("commit_slot"))
    return prepares.join(commits, "prepare_slot").withColumn("lag", F.col("commit_slot") - F.col("prepare_slot"))


def resolutions(waiting: DataFrame, attachments: DataFrame) -> DataFrame:
    """prepare_slot and decision: commit if a device of the job has gone as far, else rollback; fatal without attachment.

    ``waiting``: prepare_slot, devices (array); ``attachments``: device, user_slot.
    """
    each = waiting.select("prepare_slot", F.explode("devices").alias("device"))
    met = each.join(attachments, "device", "left")
    decision = F.when(F.bool_or(F.col("user_slot").isNull()), "fatal").when(F.bool_or(F.col("user_slot") >= F.col("prepare_slot")), "commit").otherwise("rollback")
    return met.groupBy("prepare_slot").agg(decision.alias("decision"))


def commit_grants(jobs: DataFrame, sizes: DataFrame) -> DataFrame:
    """commit_slot, prepare_slot and grant of each commit: the bytes of both its slots. ``sizes``: seq, size."""
    pairs = committed(jobs)
    of = lambda name, key: sizes.select(F.col("seq").alias(key), F.col("size").alias(name))
    met = pairs.join(of("a", "prepare_slot"), "prepare_slot").join(of("b", "commit_slot"), "commit_slot")
    return met.select("commit_slot", "prepare_slot", (F.col("a") + F.col("b")).alias("grant"))


def exactly_once(updates: DataFrame) -> DataFrame:
    """Add status: a row applies if its user_slot is above all that its client sent before, in order of arrival.

    ``updates``: arrival, client, user_slot, attached. Equal slots change nothing; clients not attached are refused.
    """
    rows = running(updates, ("client",), "arrival", F.when(F.col("attached"), F.col("user_slot")), "max", "_last", inclusive=False)
    last = F.col("_last")
    status = F.when(~F.col("attached"), "not_attached").when(last.isNull() | (last < F.col("user_slot")), "applied").otherwise("no_change")
    return rows.select("arrival", "client", "user_slot", status.alias("status"))


def attachments(events: DataFrame) -> DataFrame:
    """client, user_slot of clients whose latest event is an attach. ``events``: client, slot, kind."""
    last = events.groupBy("client").agg(F.max_by("kind", "slot").alias("kind"), F.max("slot").alias("user_slot"))
    return last.filter("kind = 'attach'").select("client", "user_slot")


def kv_replay(events: DataFrame) -> DataFrame:
    """key, value after all events: the last one of a key wins; a removed key is gone."""
    last = events.groupBy("key").agg(F.max_by(F.struct("op", "value"), "seq").alias("x"))
    return last.filter("x.op = 'upsert'").select("key", F.col("x.value").alias("value"))


def latest(rows: DataFrame, keys: list[str], order: str | Column, *columns: str) -> DataFrame:
    """The columns of each key's latest row."""
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("x"))
    return picked.select(*keys, *(F.col(f"x.{c}").alias(c) for c in columns))


def previous_user_slot(jobs: DataFrame) -> DataFrame:
    """Each user's prepares with the prepare before, which must be durable first."""
    prepares = jobs.filter("kind = 'prepare'").select("user_id", "prepare_slot")
    return running(prepares, ("user_id",), "prepare_slot", F.col("prepare_slot"), "last", "prev_user_slot", inclusive=False)


def locked_lower_bound(locks: DataFrame) -> DataFrame:
    """One row: the least lower bound of locks still held; with none held the highest upper bound seen."""
    held = F.min(F.when(F.col("held"), F.col("lower")))
    return locks.agg(F.coalesce(held, F.max("upper")).alias("lower_bound"))


def trim_grants(locks: DataFrame, requests: DataFrame) -> DataFrame:
    """at, target, granted: how far each trim may go, the least of its target and the lower bounds of locks then held.

    ``locks``: lower, released. A lock is taken at its lower bound and held up to, not at, the position of its release;
    null is a lock still held. ``requests``: at, target; those without a position are left out. The earliest lock that
    a release after ``at`` ends is the lowest one held, or was taken later and pins nothing, so one running maximum
    from the log's end finds it for all requests.
    """
    held = locks.filter("released IS NULL").agg(F.min("lower").alias("_held"))
    ended = locks.filter("released IS NOT NULL").select((F.col("released") * -2).alias("_order"), "lower", F.lit(None).cast("long").alias("at"), F.lit(None).cast("long").alias("target"))
    asked = requests.filter("at IS NOT NULL").select((F.col("at") * -2 - 1).alias("_order"), F.lit(None).cast("long").alias("lower"), "at", "target")
    rows = running(ended.unionByName(asked), (), "_order", -F.col("lower"), "max", "_open").filter("at IS NOT NULL")
    pins = lambda lower: F.when(lower <= F.col("at"), lower)
    granted = F.least("target", pins(-F.col("_open")), pins(F.col("_held")))
    return rows.crossJoin(F.broadcast(held)).select("at", "target", granted.alias("granted"))


def latencies(jobs: DataFrame, times: DataFrame) -> DataFrame:
    """kind, n, total_us, min_us, max_us: the time from a job's prepare to each commit or rollback of it.

    ``times``: seq, us. A record without a time is counted, but adds nothing to the times.
    """
    ends = jobs.filter("kind <> 'prepare'").join(times.select("seq", F.col("us").alias("_end")), "seq")
    took = ends.join(times.select(F.col("seq").alias("prepare_slot"), F.col("us").alias("_begin")), "prepare_slot").withColumn("_us", F.col("_end") - F.col("_begin"))
    return took.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("_us").alias("total_us"), F.min("_us").alias("min_us"), F.max("_us").alias("max_us"))


def pending_trim(trims: DataFrame, trim_pos: Column) -> DataFrame:
    """The last trim event (seq, old_trim, new_trim), if the log was not yet trimmed that far."""
    last = trims.agg(F.max_by(F.struct("seq", "old_trim", "new_trim"), "seq").alias("x")).filter("x IS NOT NULL").select("x.*")
    return last.filter(trim_pos < F.col("new_trim"))


def allocate(first: DataFrame, places: int) -> DataFrame:
    """Add status to clients (client, slot, unique): those that come after ``places`` others get none."""
    status = F.when(F.col("_n") <= places, "kOk").otherwise("kOutOfAttachments")
    return running(first, (), "slot", F.lit(1), "sum", "_n").select("client", "slot", status.alias("status"))


def out_of_order(jobs: DataFrame) -> DataFrame:
    """Resolved jobs whose user's job before is unresolved or was resolved later: user_id, prepare_slot, previous, code.

    Chained jobs become durable in order, so any row is a violation.
    """
    done = jobs.filter("kind <> 'prepare'").groupBy("prepare_slot").agg(F.min("seq").alias("done"))
    chained = previous_user_slot(jobs).select("user_id", "prepare_slot", F.col("prev_user_slot").alias("previous")).filter("previous IS NOT NULL")
    before = done.select(F.col("prepare_slot").alias("previous"), F.col("done").alias("before"))
    met = chained.join(done, "prepare_slot").join(before, "previous", "left").filter("before IS NULL OR before > done")
    return met.select("user_id", "prepare_slot", "previous", F.when(F.col("before").isNull(), "previous_unresolved").otherwise("previous_later").alias("code"))
