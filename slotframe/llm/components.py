"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotframe.llm.common import stage

#: Each round at least halves the longest way to a root in practice; far more than any graph needs.
MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each larger neighbour of a node to the smallest of node and neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them; edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    met = edges.join(least, "u")
    lower = met.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return lower.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(u long, v long) edges to (node, root): each node that has an edge, with the smallest node of its component.

    Nodes of one component may be all of the table: no step gathers them, joins on a frequent node are plain joins
    that Spark can split. Each round is written to the shared folder. Loops are ignored; no edges give no rows.
    """
    now = stage(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(MAX_ROUNDS):
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not mark[0] or mark == seen:
            break
        seen = mark
        now = stage(_small_star(_large_star(now)), "edges")
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
