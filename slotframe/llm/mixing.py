"""Mixing sources to target weights, with DataFrame functions only.

The words of a source, its documents laid end to end, are packed into blocks of fixed length. The output is a run
of shards of ``shard_slots`` slots; each slot draws its source, which gives each shard a multinomial count of every
source. The n-th slot of a source takes block perm(n mod blocks), where perm is a keyed pseudorandom permutation of
the block indexes, a new one for each pass over the source. Slots and documents then meet by block index.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotframe.llm.common import WHITE, prefix_sums, stage, words
from slotframe.llm.row_keys import text_key

#: Parts into which the slots are cut to find a drawn slot's source by an equi-join.
LOOKUP_PARTS = 4096
#: Documents of one source that are laid end to end by one task.
CHUNK_DOCS = 1024
#: A source has at least so many blocks, if it has the words.
LEAST_BLOCKS = 512


@dataclass(frozen=True)
class Mix:
    """weights repeat over the sources in code point order, null last; share and cap are multiples of words."""

    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    share: float = 1.5
    cap: float = 2.0
    block_words: int = 2048
    shard_slots: int = 1024
    rounds: int = 24
    seed: int = 42


def source_plan(sized: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """A row for each source: source, rank, source_size, target, block, n_blocks, n_slots.

    Targets share ``share`` of all words by weight. The level at which sources stop at ``cap`` is found by walking
    the sources in the order in which they reach it.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    s = sizes.withColumn("rank", F.row_number().over(by_name) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, mix.weights)), (F.col("rank") % len(mix.weights) + 1).cast("int")))
    s = s.withColumn("most", mix.cap * F.col("source_size"))
    before = Window.orderBy(F.col("most") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    left = mix.share * F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    s = s.withColumn("level", left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    s = s.withColumn("ratio", F.col("most") / F.col("weight"))
    level = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "rank", "level"))).over(everything)["level"]
    s = s.withColumn("target", F.least(F.col("most"), F.coalesce(level * F.col("weight"), F.col("most"))))
    s = s.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(mix.block_words), F.floor(F.col("source_size") / LEAST_BLOCKS))).cast("long"))
    s = s.withColumn("n_blocks", F.ceil(F.col("source_size") / F.col("block")).cast("long"))
    slots = F.when(F.col("source_size") > 0, F.round(F.col("target") * F.col("n_blocks") / F.col("source_size")))
    s = s.withColumn("n_slots", F.least(F.coalesce(slots, F.lit(0)).cast("long"), F.floor(mix.cap * F.col("n_blocks")).cast("long")))
    return s.select("source", "rank", "source_size", "target", "block", "n_blocks", "n_slots")


def permuted(index: Column, n: Column, key: Column, rounds: int) -> Column:
    """Swap-or-not shuffle: a keyed permutation of 0 .. n-1 for any n, without walking or sorting."""

    def step(x: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(key, r), n) - x, n)
        swap = F.pmod(F.xxhash64(key, r, F.greatest(x, partner), F.lit("swap")), F.lit(2)) == 1
        return F.when(swap, partner).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), index.cast("long"), step)


def mix_slots(plan: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The output in slots: shard, rank (of the source), slot (within the source), block_index.

    Draws beyond a source's share are void; what the draws leave of a share goes to closing shards, numbered after
    the others. So each source gets exactly its n_slots. Equal inputs give equal slots.
    """
    spark = plan.sparkSession
    n = plan.agg(F.sum("n_slots")).first()[0] or 0
    if n == 0:
        return spark.createDataFrame([], "shard long, rank int, slot long, block_index long")
    part = -(-n // LOOKUP_PARTS)
    upto = Window.orderBy("rank")
    ranges = plan.filter("n_slots > 0").select("rank", F.sum("n_slots").over(upto).alias("hi"), "n_slots").withColumn("lo", F.col("hi") - F.col("n_slots"))
    ranges = ranges.withColumn("part", F.explode(F.sequence(F.expr(f"lo div {part}"), F.expr(f"(hi - 1) div {part}"))))
    drawn = spark.range(n).select(F.expr(f"id div {mix.shard_slots}").alias("shard"), F.pmod(F.xxhash64(F.lit(mix.seed), F.lit("draw"), "id"), F.lit(n)).alias("u"))
    drawn = drawn.withColumn("part", F.expr(f"u div {part}")).join(ranges.select("rank", "lo", "hi", "part"), "part").filter("u >= lo AND u < hi")
    counts = stage(drawn.groupBy("shard", "rank").agg(F.count(F.lit(1)).alias("n")), "mix-counts")
    shards = -(-n // mix.shard_slots)
    placed = prefix_sums(counts, ["rank"], "shard", "n", "slot0")
    totals = counts.groupBy("rank").agg(F.sum("n").alias("drawn"))
    short = plan.select("rank", "n_slots").join(totals, "rank", "left").withColumn("slot0", F.coalesce("drawn", F.lit(0)).cast("long"))
    closing = short.filter("n_slots > slot0").select(F.lit(shards).cast("long").alias("shard"), "rank", "slot0", (F.col("n_slots") - F.col("slot0")).alias("n"))
    runs = placed.select("shard", "rank", "slot0", "n").unionByName(closing).join(plan.select("rank", "n_slots", "n_blocks"), "rank")
    runs = runs.withColumn("end", F.least(F.col("slot0") + F.col("n"), F.col("n_slots"))).filter("end > slot0")
    slots = runs.withColumn("slot", F.explode(F.sequence(F.col("slot0"), F.col("end") - 1)))
    key = F.xxhash64(F.lit(mix.seed), F.lit("block"), "rank", F.expr("slot div n_blocks"))
    shard = F.when(F.col("shard") < shards, F.col("shard")).otherwise(F.col("shard") + F.expr(f"(slot - slot0) div {mix.shard_slots}"))
    slots = slots.select(shard.alias("shard"), "rank", "slot", "n_blocks", key.alias("key"), F.pmod("slot", "n_blocks").alias("i"))
    return slots.select("shard", "rank", "slot", permuted(F.col("i"), F.col("n_blocks"), F.col("key"), mix.rounds).alias("block_index"))


def _sized(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words(F.col("text")).alias("size"), *more)


def _parts(sized: DataFrame, plan: DataFrame, mix: Mix, *keys: str) -> DataFrame:
    """The rows of ``sized`` cut at block ends: where each lies in its source (at), block_index, overlap.

    ``keys`` order rows of one id and size. A row without words has one part without a block.
    """
    n_chunks = max(1, -(-sized.count() // CHUNK_DOCS))
    rows = sized.withColumnRenamed("source", "_source").join(plan, F.col("_source").eqNullSafe(F.col("source")))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64(F.lit(mix.seed), "doc_id", "size"), F.lit(n_chunks)))
    number = Window.partitionBy("rank", "chunk").orderBy("doc_id", "size", *keys)
    inside = number.rowsBetween(Window.unboundedPreceding, -1)
    starts = prefix_sums(rows.groupBy("rank", "chunk").agg(F.sum("size").alias("words")), ["rank"], "chunk", "words", "chunk_at").select("rank", "chunk", "chunk_at")
    rows = rows.withColumn("n", F.row_number().over(number)).withColumn("inner_at", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(starts, ["rank", "chunk"]).withColumn("at", F.col("chunk_at") + F.col("inner_at"))
    spans = F.when(F.col("size") > 0, F.sequence(F.expr("at div block"), F.expr("(at + size - 1) div block")))
    parts = rows.drop("_source", "chunk_at", "inner_at", "n_slots", "n_blocks").withColumn("block_index", F.explode_outer(spans))
    begin = F.col("block_index") * F.col("block")
    return parts.withColumn("overlap", F.least(F.col("at") + F.col("size"), begin + F.col("block")) - F.greatest(F.col("at"), begin))


def _taken(sized: DataFrame, mix: Mix, *keys: str) -> DataFrame:
    """What the mix takes of each row of ``sized``."""
    plan = stage(source_plan(sized, mix), "mix-plan")
    uses = mix_slots(plan, mix).groupBy("rank", "block_index").agg(F.count(F.lit(1)).alias("uses"))
    met = _parts(sized, plan, mix, *keys).join(uses, ["rank", "block_index"], "left")
    taken = F.coalesce(F.sum(F.col("overlap") * F.col("uses")), F.lit(0)).cast("long")
    whole = met.groupBy("rank", "chunk", "n").agg(*(F.first(c).alias(c) for c in ("doc_id", *keys, "size", "source_size", "target")), taken.alias("taken"))
    return whole.select("doc_id", *keys, "size", "source_size", "target", "taken")


def mix_sources(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text, source): doc_id, size, source_size, target, taken.

    ``taken`` counts the words of the document in the blocks that the mix takes, repeats counted; it is at most
    ``cap`` times the size. Each source's sum is within a few blocks of its target.

    Nulls and ties: a null text has no words; null is a source of its own, after all others; documents without words
    are never taken. Documents of a source lie in the order of a hash of their ids, then by id and size, so repeated
    ids and rows each take part. An empty table gives an empty result. Only the three columns named are read.
    """
    return _taken(stage(_sized(docs), "mix-sizes"), mix)


def mixed_blocks(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The mix itself, a row for each slot: shard, source, slot, block_index, n_words, text.

    A block's text is its words in a row, with a space between; blocks are gathered by index, and the slots that take a
    block each get it. Nulls and ties as in ``mix_sources``; rows of one id and size lie in the order of their texts'
    digests. No words at all give no rows.
    """
    sized = stage(_sized(docs, text_key(F.col("text")).alias("key"), F.col("text")), "mix-texts")
    plan = stage(source_plan(sized, mix), "mix-plan")
    parts = _parts(sized, plan, mix, "key").filter("overlap > 0")
    from_word = F.greatest(F.lit(0), F.col("block_index") * F.col("block") - F.col("at"))
    piece = F.slice(F.regexp_extract_all("text", F.lit(f"([^{WHITE}]+)"), F.lit(1)), (from_word + 1).cast("int"), F.col("overlap").cast("int"))
    pieces = parts.select("rank", "block_index", "source", F.struct("at", F.array_join(piece, " ").alias("piece")).alias("x"), "overlap")
    blocks = pieces.groupBy("rank", "block_index").agg(F.first("source").alias("source"), F.sum("overlap").alias("n_words"), F.array_sort(F.collect_list("x")).alias("xs"))  # at most block words
    text = F.array_join(F.transform("xs", lambda x: x["piece"]), " ")
    met = mix_slots(plan, mix).join(blocks.select("rank", "block_index", "source", "n_words", text.alias("text")), ["rank", "block_index"])
    return met.select("shard", "source", "slot", "block_index", "n_words", "text")


def mixed_documents(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as the mix takes its text, 0, 1 or 2 times.

    Rows are told apart by doc_id and text; rows that are equal in both share evenly what is taken of them. A part of a
    text counts as a chance: the row comes once more if a hash falls below that part. Rows without words are left out,
    as the mix never takes them.
    """
    takes = _taken(stage(_sized(docs, text_key(F.col("text")).alias("key")), "mix-sizes"), mix, "key").filter("size > 0")
    times = takes.groupBy(F.coalesce("doc_id", F.lit(-1)).alias("_id"), F.col("doc_id").isNull().alias("_null"), F.col("key").alias("_key")).agg((F.sum("taken") / F.sum("size")).alias("_times"))
    doc_id = docs["doc_id"].cast("long")
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(doc_id, F.lit(-1)).alias("_id"), doc_id.isNull().alias("_null"), text_key(docs["text"]).alias("_key"), F.monotonically_increasing_id().alias("_rid"))
    chance = F.pmod(F.xxhash64(F.lit(mix.seed), F.lit("copy"), "_id", "_key", "_rid"), F.lit(1 << 20)) / float(1 << 20)
    n = (F.floor("_times") + F.when(chance < F.col("_times") - F.floor("_times"), 1).otherwise(0)).cast("int")
    met = rows.join(times.filter("_times > 0"), ["_id", "_null", "_key"]).withColumn("_n", n).filter("_n > 0")
    return met.select("row", F.explode(F.sequence(F.lit(1), F.col("_n")))).select("row.*")
