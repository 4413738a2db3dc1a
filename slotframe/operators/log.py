"""Framing, bounds, scans and demultiplexing of a slot-addressed log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotframe.functions.packed import varint_size

#: Rows of consecutive sequence numbers that one task adds up.
CHUNK = 65536
USER_KINDS = ("raw", "commit")


def running(df: DataFrame, keys: tuple[str, ...], order: str, value: Column, how: str, out: str, inclusive: bool = True, chunk: int = CHUNK) -> DataFrame:
    """Add ``out``: the sum, max or last non-null ``value`` of rows of equal ``keys`` up to this one by ``order``.

    Two passes: within chunks of the order, and over all chunks before. One task meets at most a chunk of rows of a
    key, or one row for each of its chunks, so neither a long log nor a key with most of the rows is a bottleneck.
    """
    fold = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}[how]
    whole = {"sum": F.sum("_v"), "max": F.max("_v"), "last": F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col(order)))}[how]
    cut = df.withColumn("_chunk", F.expr(f"`{order}` div {chunk}")).withColumn("_v", value)
    inner = Window.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    outer = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = cut.groupBy(*keys, "_chunk").agg(whole.alias("_c")).select(*keys, "_chunk", fold("_c").over(outer).alias("_before"))
    rows = cut.withColumn("_in", fold("_v").over(inner)).join(before, [*keys, "_chunk"])
    inside, carried = F.col("_in"), F.col("_before")
    if how == "sum":
        both = F.coalesce(inside, F.lit(0)) + F.coalesce(carried, F.lit(0))
    else:
        both = F.greatest(inside, carried) if how == "max" else F.coalesce(inside, carried)
    return rows.withColumn(out, both).drop("_chunk", "_v", "_in", "_before")


def running_total(df: DataFrame, order: str, value: str, out: str, keys: tuple[str, ...] = (), chunk: int = CHUNK) -> DataFrame:
    """Add ``out``, the sum of ``value`` over rows up to this one by ``order``."""
    return running(df, keys, order, F.col(value), "sum", out, chunk=chunk).withColumn(out, F.col(out).cast("long"))


def frame(log: DataFrame) -> DataFrame:
    """Add header_size, slot_lower and slot_upper; records follow one another without gaps."""
    sized = log.withColumn("header_size", varint_size(F.col("body_size")).cast("long")).withColumn("_size", F.col("header_size") + F.col("body_size"))
    framed = running_total(sized, "seq", "_size", "slot_upper")
    return framed.withColumn("slot_lower", F.col("slot_upper") - F.col("_size")).drop("_size")


def bounds(log: DataFrame) -> DataFrame:
    """One row: trim_pos, flush_pos and commit_pos at a quarter, three quarters and all of the bytes."""
    total = F.coalesce(F.sum(varint_size(F.col("body_size")) + F.col("body_size")), F.lit(0)).cast("long")
    at = lambda percent: F.floor(F.col("t") * percent / 100).cast("long")
    return log.agg(total.alias("t")).select(at(25).alias("trim_pos"), at(75).alias("flush_pos"), F.col("t").alias("commit_pos"))


def with_bounds(framed: DataFrame, log: DataFrame) -> DataFrame:
    """Each slot beside the one row of bounds."""
    return framed.crossJoin(F.broadcast(bounds(log)))


def non_empty(framed: DataFrame) -> DataFrame:
    """Slots without a body are passed over; they keep their place in the offsets."""
    return framed.filter("body_size > 0")


def before(framed: DataFrame, bound: str | Column) -> DataFrame:
    """Slots that begin before ``bound``."""
    return framed.filter(F.col("slot_lower") < bound)


def visible(bounded: DataFrame, mode: str) -> DataFrame:
    """Slots that a reader sees: durable ends at flush_pos, speculative and inconsistent at commit_pos."""
    if mode not in ("durable", "speculative", "inconsistent"):
        raise ValueError(mode)
    return bounded.filter(F.col("slot_upper") <= F.col("flush_pos" if mode == "durable" else "commit_pos"))


def in_range(framed: DataFrame, lower: Column | None, upper: Column | None) -> DataFrame:
    """Whole slots between the bounds; an open bound leaves its side free."""
    out = framed if lower is None else framed.filter(F.col("slot_lower") >= lower)
    return out if upper is None else out.filter(F.col("slot_upper") <= upper)


def by_kind(framed: DataFrame) -> DataFrame:
    """kind_tag, kind, slots and bytes; a record without a known kind fails the scan."""
    known = F.when(F.col("kind_tag").isNull(), F.raise_error(F.lit("kBadPackedVariant")).cast("int")).otherwise(F.col("kind_tag"))
    rows = framed.withColumn("kind_tag", known)
    return rows.groupBy("kind_tag", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("body_size").alias("bytes"))


def user_slots(framed: DataFrame) -> DataFrame:
    """What the user of a volume sees: raw data and committed jobs."""
    return framed.filter(F.col("kind").isin(*USER_KINDS))


def first_slot(framed: DataFrame) -> DataFrame:
    return framed.orderBy("slot_lower").limit(1)


def progress(slots: DataFrame) -> DataFrame:
    """How many slots were visited and up to where."""
    return slots.agg(F.count(F.lit(1)).alias("n"), F.max("slot_upper").alias("visited_upper"))


def read_bytes(requests: DataFrame, limits: DataFrame) -> DataFrame:
    """id, lo, hi with status and n_bytes: ranges are read between the locked lower bound and the end of the log."""
    rows = requests.crossJoin(F.broadcast(limits))
    bad = F.col("hi") < F.col("lo")
    outside = (F.col("lo") < F.col("locked")) | (F.col("hi") > F.col("log_end"))
    status = F.when(bad, "kInvalidArgument").when(outside, "kOutOfRange").otherwise("kOk")
    return rows.select("id", "lo", "hi", status.alias("status"), F.when(status == "kOk", F.col("hi") - F.col("lo")).otherwise(F.lit(0)).alias("n_bytes"))


def batch_appends(log: DataFrame, batch: Column) -> DataFrame:
    """batch, n, lower, upper, contiguous: slots of a batch are written as one and lie side by side."""
    framed = frame(log).withColumn("batch", batch)
    out = framed.groupBy("batch").agg(
        F.count(F.lit(1)).alias("n"), F.min("slot_lower").alias("lower"), F.max("slot_upper").alias("upper"), F.sum(F.col("slot_upper") - F.col("slot_lower")).alias("_bytes")
    )
    return out.select("batch", "n", "lower", "upper", (F.col("upper") - F.col("lower") == F.col("_bytes")).alias("contiguous"))


def predecessor(df: DataFrame, order: str, value: str, out: str, keys: tuple[str, ...] = (), first: object = None, chunk: int = CHUNK) -> DataFrame:
    """Add ``out``: ``value`` of the row before by ``order``; ``first`` for the first row.

    The last row of each chunk is carried to the next, so no task sees more than a chunk and one row for each chunk.
    """
    cut = df.withColumn("_chunk", F.expr(f"`{order}` div {chunk}"))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(order)
    ends = cut.groupBy(*keys, "_chunk").agg(F.max_by(value, order).alias("_end"))
    carried = ends.select(*keys, "_chunk", F.lag("_end").over(Window.partitionBy(*keys).orderBy("_chunk")).alias("_carried"))
    rows = cut.withColumn("_first", F.row_number().over(inside) == 1).withColumn("_lag", F.lag(value).over(inside)).join(carried, [*keys, "_chunk"])
    found = F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_lag"))
    return rows.withColumn(out, F.coalesce(found, F.lit(first)) if first is not None else found).drop("_chunk", "_first", "_lag", "_carried")


def sort_segments(segments: DataFrame) -> DataFrame:
    """base, n_bytes and gap of log segments in order: gap is the bytes missing since the end of the one before, or shared with it if below 0."""
    ends = segments.select("base", "n_bytes", (F.col("base") + F.col("n_bytes")).alias("_end"))
    return predecessor(ends, "base", "_end", "_before", first=0).select("base", "n_bytes", (F.col("base") - F.col("_before")).alias("gap")).orderBy("base")


def monotone_violations(slots: DataFrame) -> DataFrame:
    """n slots, and those whose upper bound isn't above that of the slot visited before."""
    seen = predecessor(slots, "seq", "slot_upper", "before")
    return seen.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("slot_upper") <= F.col("before")).alias("violations"))


def all_kinds(framed: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """One row for each kind there is, also for those the log doesn't hold."""
    names = framed.sparkSession.createDataFrame(list(enumerate(kinds)), "kind_tag int, kind string")
    counts = framed.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    return names.join(counts, "kind", "left").select("kind_tag", "kind", F.coalesce("n", F.lit(0)).alias("n"))


def header_status(headers: DataFrame, page_size: int) -> DataFrame:
    """page_id and the first check that its header fails."""
    from slotframe.functions import packed
    from slotframe.functions.names import PAGE_MAGIC

    size = F.lit(page_size)
    same = packed.same_physical_page(F.col("page_id"), F.col("header_page_id"))
    other = F.col("page_id") != F.col("header_page_id")
    status = (
        F.when(F.col("magic") != PAGE_MAGIC, "kPageHeaderBadMagic")
        .when(F.col("size") != size, "kPageHeaderBadPageSize")
        .when(F.col("unused_begin") > F.col("unused_end"), "kPageHeaderBadUnusedSize")
        .when(F.col("unused_begin") > size, "kPageHeaderBadUnusedBegin")
        .when(F.col("unused_end") > size, "kPageHeaderBadUnusedEnd")
        .when(other & same, "kPageHeaderBadGeneration")
        .when(other, "kPageHeaderBadPageId")
        .otherwise("kOk")
    )
    return headers.select("page_id", status.alias("status"))


def require_layout(pages: DataFrame, layout: str | None) -> DataFrame:
    """page_id and status; no layout accepts all pages."""
    ok = F.lit(True) if layout is None else F.col("layout_id").eqNullSafe(F.lit(layout))
    return pages.select("page_id", F.when(ok, "kOk").otherwise("kPageHeaderBadLayoutId").alias("status"))
