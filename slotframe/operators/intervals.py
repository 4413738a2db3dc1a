"""Half-open intervals, and piecewise-constant maps of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def intersect(a_lo: Column, a_hi: Column, b_lo: Column, b_hi: Column) -> Column:
    """Struct (lo, hi) of the overlap, null if there is none."""
    lo, hi = F.greatest(a_lo, b_lo), F.least(a_hi, b_hi)
    return F.when(lo < hi, F.struct(lo.alias("lo"), hi.alias("hi")))


def without(a_lo: Column, a_hi: Column, b_lo: Column, b_hi: Column) -> Column:
    """Array of the 0 to 2 pieces of the first interval outside the second."""
    left = F.struct(a_lo.alias("lo"), F.least(a_hi, b_lo).alias("hi"))
    right = F.struct(F.greatest(a_lo, b_hi).alias("lo"), a_hi.alias("hi"))
    whole = F.struct(a_lo.alias("lo"), a_hi.alias("hi"))
    pieces = F.filter(F.array(left, right), lambda p: p["lo"] < p["hi"])
    return F.when((b_lo >= b_hi) | (b_hi <= a_lo) | (a_hi <= b_lo), F.filter(F.array(whole), lambda p: p["lo"] < p["hi"])).otherwise(pieces)


def is_empty(lo: Column, hi: Column) -> Column:
    return lo >= hi


#: Offsets that one task sweeps together. Ranges are cut at its multiples, so a map with most of the updates is spread.
CELL = 4096


def cells(ranges: DataFrame, lo: str = "lo", hi: str = "hi", cell: int = CELL) -> DataFrame:
    """Non-empty ranges cut at multiples of ``cell``: the same columns, clipped, and ``cell``."""
    spans = F.sequence(F.floor(F.col(lo) / cell), F.floor((F.col(hi) - 1) / cell))
    cut = ranges.filter(F.col(lo) < F.col(hi)).withColumn("cell", F.explode(spans))
    return cut.withColumn(lo, F.greatest(F.col(lo), F.col("cell") * cell)).withColumn(hi, F.least(F.col(hi), (F.col("cell") + 1) * cell))


def runs(updates: DataFrame, cell: int = CELL) -> DataFrame:
    """map_key, lo, hi, slot: at each offset the highest slot that wrote it, equal neighbours merged.

    A sweep over boundaries, cell by cell: an update is cut only at the boundaries in the cells that it covers, and
    equal updates are folded first. Runs that go on in the next cell are joined at the end.
    """
    parts = cells(updates.groupBy("map_key", "lo", "hi").agg(F.max("slot").alias("slot")), cell=cell)
    parts = parts.groupBy("map_key", "cell", "lo", "hi").agg(F.max("slot").alias("slot"))
    cuts = parts.select("map_key", "cell", F.col("lo").alias("at")).union(parts.select("map_key", "cell", "hi")).distinct()
    steps = cuts.withColumn("next", F.lead("at").over(Window.partitionBy("map_key", "cell").orderBy("at"))).filter("next IS NOT NULL")
    covered = steps.join(parts, ["map_key", "cell"]).filter("lo <= at AND at < hi").groupBy("map_key", "cell", "at", "next").agg(F.max("slot").alias("slot"))
    inside = _merged(covered.select("map_key", "cell", F.col("at").alias("lo"), F.col("next").alias("hi"), "slot"), ("map_key", "cell"))
    return _merged(inside.drop("cell"), ("map_key",))


def _merged(pieces: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Pieces that touch and have one slot, joined."""
    w = Window.partitionBy(*keys).orderBy("lo")
    new = F.when((F.lag("slot").over(w) == F.col("slot")) & (F.lag("hi").over(w) == F.col("lo")), 0).otherwise(1)
    marked = pieces.withColumn("new", new).withColumn("run", F.sum("new").over(w))
    return marked.groupBy(*keys, "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.first("slot").alias("slot")).drop("run")


def dense(merged: DataFrame, size: int) -> DataFrame:
    """map_key, at, slot for each offset of 0 .. size-1 of each map, 0 where nothing was written."""
    keys = merged.select("map_key").distinct().withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(size - 1)).cast("array<long>")))
    each = merged.select("map_key", "slot", F.explode(F.sequence(F.col("lo"), F.col("hi") - 1)).alias("at"))
    return keys.join(each, ["map_key", "at"], "left").select("map_key", "at", F.coalesce("slot", F.lit(0)).cast("long").alias("slot"))


def lookup(merged: DataFrame, queries: DataFrame, cell: int = CELL) -> DataFrame:
    """Runs that meet a query range (q_lo, q_hi) of the same map, clipped to it.

    Both sides are cut into cells, so that the join has the cell as a key; the pieces of a run are then joined.
    """
    asked = cells(queries.withColumn("_lo", F.col("q_lo")).withColumn("_hi", F.col("q_hi")), "_lo", "_hi", cell)
    met = cells(merged, cell=cell).join(asked, ["map_key", "cell"]).filter("lo < _hi AND _lo < hi")
    pieces = met.select("map_key", "q_lo", "q_hi", F.greatest("lo", "_lo").alias("lo"), F.least("hi", "_hi").alias("hi"), "slot")
    return _merged(pieces.distinct(), ("map_key", "q_lo", "q_hi"))


def hull(ranges: DataFrame, *keys: str) -> DataFrame:
    """The least range over all ranges of a key."""
    return ranges.groupBy(*keys).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
