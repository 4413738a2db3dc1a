"""Page graphs: traversal, reference counts, pruning, recursive release."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotframe.operators.staging import stage, stage_counted

#: A page that is deleted goes from count 1 to 0 by this delta, whatever else is added.
DROP = -(1 << 31)
#: Deepest release of a recycled page. A traversal has no such bound.
MAX_DEPTH = 32


def out_refs(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """Direct references of the pages (page_id)."""
    return edges.join(pages.select(F.col("page_id").alias("src")), "src", "left_semi")


def reach(edges: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """page_id and depth of every page that the roots lead to, roots included, by the shortest way.

    A frontier step is one equi-join and one anti join; each frontier is written before the next step, so the plan
    stays short and a lost executor costs one step. The loop ends when a step finds nothing new.
    """
    seen = stage(roots.select("page_id").distinct().withColumn("depth", F.lit(0)))
    front, depth = seen, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        found = edges.join(front.select(F.col("page_id").alias("src")), "src").select(F.col("dst").alias("page_id")).distinct()
        front, n = stage_counted(found.join(seen, "page_id", "left_anti").withColumn("depth", F.lit(depth)))
        if not n:
            break
        seen = seen.unionByName(front)
        if depth % MAX_DEPTH == 0:  # a deep graph's union stays short
            seen = stage(seen)
    return seen


def trace(edges: DataFrame, roots: DataFrame, recurse: Column | None = None) -> DataFrame:
    """Every edge that a traversal from the roots passes, once; the roots themselves aren't called.

    ``recurse``: a condition on dst. Pages that don't meet it are found, but their references aren't followed; a root's
    always are.
    """
    within = edges if recurse is None else edges.join(edges.filter(recurse).select(F.col("dst").alias("src")).unionByName(roots.select(F.col("page_id").alias("src"))).distinct(), "src", "left_semi")
    return _passed(within, reach(within, roots))


def _passed(edges: DataFrame, seen: DataFrame) -> DataFrame:
    return edges.join(seen.select(F.col("page_id").alias("src")), "src", "left_semi")


def leaves(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """Pages known to refer to nothing, which a tracer needn't load."""
    return pages.join(edges.select(F.col("src").alias("page_id")), "page_id", "left_anti")


def unreachable(new_pages: DataFrame, roots: DataFrame, edges: DataFrame) -> DataFrame:
    """New pages that no root leads to."""
    return new_pages.join(reach(edges, roots), "page_id", "left_anti").select("page_id")


def deltas(new_pages: DataFrame, new_roots: DataFrame, old_roots: DataFrame, deleted: DataFrame, edges: DataFrame) -> DataFrame:
    """page_id and delta of a job, zero deltas left out.

    +1 a new page, +1 a new root, -1 an old root, +1 a reference from a new page that the new roots reach, -1 a
    reference from a deleted page; a deleted page itself gets DROP, which wins over all else.
    """
    live = new_pages.join(reach(edges, new_roots), "page_id", "left_semi")
    one = lambda df, n: df.select("page_id", F.lit(n).cast("long").alias("delta"))
    refs = lambda pages, n: one(out_refs(edges, pages).select(F.col("dst").alias("page_id")), n)
    signed = one(live, 1).unionByName(one(new_roots, 1)).unionByName(one(old_roots, -1)).unionByName(refs(live, 1)).unionByName(refs(deleted, -1))
    summed = signed.groupBy("page_id").agg(F.sum("delta").alias("delta")).join(deleted, "page_id", "left_anti").filter("delta <> 0")
    return summed.unionByName(one(deleted, DROP))


def apply_delta(old: F.Column, delta: F.Column) -> F.Column:
    return F.when(delta == DROP, F.lit(0)).otherwise(old + delta).cast("long")


def violations(updates: DataFrame) -> DataFrame:
    """page_id and code of updates (page_id, old, delta) that break a rule of reference counts."""
    old, delta, new = F.col("old"), F.col("delta"), apply_delta(F.col("old"), F.col("delta"))
    code = (
        F.when(new < 0, "negative")
        .when((delta == DROP) & (old != 1), "dropped_while_used")
        .when((new == 0) & (delta != DROP) & (old > 0), "zero_without_drop")
        .when((old == 1) & (new != 0), "revived")
        .when((old == 0) & (new == 1), "first_below_two")
    )
    return updates.select("page_id", code.alias("code")).filter("code IS NOT NULL")


def cascade(counts: DataFrame, dead: DataFrame, edges: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """page_id and depth of all pages that die when ``dead`` (page_id) are released, depth 0 themselves.

    ``counts``: page_id, refs. A page dies when as many references as it has came from dead pages. References that go
    deeper than ``max_depth`` levels raise an error, as the graphs of this kind have no such depth.
    """
    gone = stage(dead.select("page_id").distinct().withColumn("depth", F.lit(0)))
    front = gone
    for depth in range(1, max_depth):
        touched = out_refs(edges, front).select(F.col("dst").alias("page_id")).distinct()
        lost = edges.join(gone.select(F.col("page_id").alias("src")), "src", "left_semi").join(touched.select(F.col("page_id").alias("dst")), "dst", "left_semi").groupBy(F.col("dst").alias("page_id")).agg(F.count(F.lit(1)).alias("lost"))
        died = lost.join(counts, "page_id").filter("lost >= refs").join(gone, "page_id", "left_anti")
        front, n = stage_counted(died.select("page_id", F.lit(depth).alias("depth")))
        if not n:
            return gone
        gone = gone.unionByName(front)
    if max_depth > 1 and out_refs(edges, front).isEmpty():
        return gone
    raise RuntimeError(f"pages still die at depth {max_depth - 1}, the deepest that is allowed")
