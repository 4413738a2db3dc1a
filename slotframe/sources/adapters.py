"""How plain tables become logs, page graphs, interval updates and catalogs. All of this is our own choice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotframe.functions import packed

#: Event type to (kind, tag) of the volume log.
KINDS = {"view": ("raw", 8), "signup": ("prepare", 4), "purchase": ("commit", 5), "error": ("rollback", 6), "click": ("attach", 1)}
#: Device number of each kind of page.
DEVICES = {"region": 1, "nation": 2, "customer": 3, "supplier": 4, "orders": 5, "part": 6}
#: Catalog slots: (block, tag, slot_i, n_slots, uuid).
CATALOG = (
    (0, 1, 0, 1, "6f1e2f0a-0000-4000-8000-000000000001"),
    (0, 2, 0, 2, "6f1e2f0a-0000-4000-8000-000000000002"),
    (0, 0x1000, 1, 2, "6f1e2f0a-0000-4000-8000-000000000002"),
    (0, 3, 0, 1, "6f1e2f0a-0000-4000-8000-000000000003"),
    (1, 4, 0, 1, "6f1e2f0a-0000-4000-8000-000000000004"),
    (1, 5, 0, 1, "6f1e2f0a-0000-4000-8000-000000000005"),
    (1, 6, 0, 1, "6f1e2f0a-0000-4000-8000-000000000006"),
    (1, 0, 0, 1, "6f1e2f0a-0000-4000-8000-000000000000"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log_of(events: DataFrame) -> DataFrame:
    """Events in the order of their ids are the records of a log; ``props`` is the payload."""
    kinds = F.create_map(*(F.lit(x) for k, (kind, _) in KINDS.items() for x in (k, kind)))
    tags = F.create_map(*(F.lit(x) for k, (_, tag) in KINDS.items() for x in (k, tag)))
    return events.select(
        F.col("event_id").alias("seq"),
        kinds[F.col("event_type")].alias("kind"),
        tags[F.col("event_type")].alias("kind_tag"),
        "user_id",
        F.col("props").alias("body"),
        (F.octet_length("props") + 1).cast("long").alias("body_size"),
    )


def log(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    """The log, or its records of some kinds; these are asked for by event type, so that the scan skips the others."""
    events = table(spark, sf_dir, "events")
    wanted = [t for t, (kind, _) in KINDS.items() if kind in kinds]
    return log_of(events.filter(F.col("event_type").isin(*wanted)) if kinds else events)


def kv_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, op, key, value: an error removes the user's key, all else sets it."""
    op = F.when(F.col("event_type") == "error", "remove").otherwise("upsert")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), op.alias("op"), F.col("user_id").alias("key"), F.col("props").alias("value"))


def node(kind: str, key: str | F.Column) -> F.Column:
    return packed.page_id(F.lit(DEVICES[kind]), F.lit(0), F.col(key) if isinstance(key, str) else key)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page references: a row's page refers to the pages of its foreign keys; line items link orders to parts and suppliers."""
    t = lambda name: table(spark, sf_dir, name)
    lines = t("lineitem")
    parts = [
        t("nation").select(node("nation", "n_nationkey").alias("src"), node("region", "n_regionkey").alias("dst")),
        t("customer").select(node("customer", "c_custkey").alias("src"), node("nation", "c_nationkey").alias("dst")),
        t("supplier").select(node("supplier", "s_suppkey").alias("src"), node("nation", "s_nationkey").alias("dst")),
        t("orders").select(node("orders", "o_orderkey").alias("src"), node("customer", "o_custkey").alias("dst")),
        lines.select(node("orders", "l_orderkey").alias("src"), node("part", "l_partkey").alias("dst")).distinct(),
        lines.select(node("orders", "l_orderkey").alias("src"), node("supplier", "l_suppkey").alias("dst")).distinct(),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def interval_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """map_key, lo, hi, slot over the domain 0 .. 28."""
    e = table(spark, sf_dir, "events")
    lo = F.col("event_id") % 29
    return e.select(F.col("user_id").alias("map_key"), lo.alias("lo"), (lo + 1 + F.col("event_id") % (29 - lo)).alias("hi"), F.col("event_id").alias("slot"))


def recycle_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page releases from orders: page, depth, slot of the latest refresh, batch, trim slot and page index."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        (k % 997).alias("page_id"),
        (k % 7).cast("int").alias("depth"),
        k.alias("slot"),
        F.when(k % 5 == 0, k % 40 - k % 5).alias("batch_slot"),
        F.floor(k / 50).cast("long").alias("trim_slot"),
        (k % 50).alias("page_index"),
    )


def catalog_blocks(spark: SparkSession) -> DataFrame:
    """block and its slots, as config blocks hold them."""
    flat = spark.createDataFrame(list(CATALOG), "block int, tag int, slot_i int, n_slots int, uuid string")
    return flat.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("uuid", "slot_i", "tag", "n_slots"))).alias("slots"))


def page_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of order pages of 4096 bytes, some of them damaged by rule."""
    from slotframe.functions.names import PAGE_MAGIC

    k = F.col("o_orderkey")
    page = packed.page_id(F.lit(DEVICES["orders"]), k % 8, k)
    wrong_generation = packed.page_id(F.lit(DEVICES["orders"]), k % 8 + 1, k)
    wrong_address = packed.page_id(F.lit(DEVICES["orders"]), k % 8, k + 1)
    return table(spark, sf_dir, "orders").select(
        page.alias("page_id"),
        F.when(k % 11 == 0, F.lit(0)).otherwise(F.lit(PAGE_MAGIC)).alias("magic"),
        F.when(k % 13 == 0, 8192).otherwise(4096).cast("long").alias("size"),
        F.when(k % 17 == 0, 5000).otherwise(k % 2048 + 64).cast("long").alias("unused_begin"),
        F.when(k % 19 == 0, 5001).when(k % 17 == 0, 6000).when(k % 23 == 0, 10).otherwise(4096).cast("long").alias("unused_end"),
        F.when(k % 29 == 0, wrong_generation).when(k % 31 == 0, wrong_address).otherwise(page).alias("header_page_id"),
        F.col("o_orderstatus").alias("layout_id"),
    )
