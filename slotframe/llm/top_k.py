"""Exact top-k by integer inner product, with pivot-table elimination.

With |q - x|^2 = |q|^2 + |x|^2 - 2 q.x, a lower bound of the distance is an upper bound of the score. The distances of
a vector to many pivots, worked out once, fix where it stands over the pivots' span: its coordinates there and how far
from the span it lies. The distance of two such positions is the greatest lower bound that the pivot distances allow
together; it is never below the bound of any one pivot by the triangle inequality. Candidates are scored in the order
of their bounds until no bound left reaches the k-th score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slotframe.llm import files
from slotframe.llm.common import new_path, stage

#: About so many rows of each length, drawn by hash, give each query its first k-th score; pivots are chosen out of fewer.
FIRST_GROUP, PIVOT_POOL = 8192, 1024
#: A task holds one block of queries and one group of candidates, of at most these sizes, and bounds so many queries at once.
QUERY_BLOCK, CANDIDATE_GROUP, AT_ONCE = 512, 16384, 64
STEP = 256
#: Scores are exact as 64-bit floats below this.
EXACT = float(1 << 53)
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def quantised(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """rid (a number of its own), vec_id, dim and v, the components as floor(scale * x); rows without such v are left out."""
    x = F.col("embedding")
    usable = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("double"))
    rows = vectors.filter(usable).select(F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))
    return rows.withColumn("dim", F.size("v"))


@dataclass(frozen=True)
class Pivots:
    """Pivots, their squared norms, and the inverse that takes inner products with them to coordinates in their span."""

    points: np.ndarray
    squares: np.ndarray
    back: np.ndarray

    @staticmethod
    def choose(pool: np.ndarray, n: int) -> Pivots:
        """Up to n rows of ``pool``, each the farthest from the span of those chosen before."""
        left, chosen = pool.copy(), []
        reach = (left * left).sum(axis=1)
        least = 1e-6 * float(reach.max(initial=0))
        axes = np.zeros((0, pool.shape[1]))
        while len(chosen) < min(n, len(pool)) and reach.max() > least:
            chosen.append(int(reach.argmax()))
            axis = left[chosen[-1]] / np.sqrt(reach[chosen[-1]])
            axis = axis - axes.T @ (axes @ axis)
            axes = np.concatenate([axes, axis[None] / np.sqrt(axis @ axis)])
            left = left - np.outer(left @ axes[-1], axes[-1])
            reach = (left * left).sum(axis=1)
        points = pool[chosen]
        return Pivots(points, (points * points).sum(axis=1), np.linalg.inv(points @ axes.T) if chosen else np.zeros((0, 0)))

    def distances(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), len(self.points)))
        for i in range(0, len(x), 256):
            out[i : i + 256] = np.sqrt(((x[i : i + 256, None, :] - self.points[None, :, :]) ** 2).sum(axis=2))
        return out

    def place(self, x: np.ndarray) -> np.ndarray:
        """Per row: coordinates over the pivots' span, by the distances to them; how far from it, rounded up; a margin."""
        squares = (x * x).sum(axis=1)
        far = self.distances(x)
        y = (squares[:, None] + self.squares - far * far) / 2 @ self.back.T
        off = np.sqrt(np.maximum(squares - (y * y).sum(axis=1), 0) + 1e-9 * squares)
        norm = np.sqrt(squares)
        return np.concatenate([y, off[:, None], 1e-6 * (norm + np.sqrt(self.squares.max(initial=0)))[:, None], norm[:, None]], axis=1)


def upper_bounds(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """No score of a query (row) and a candidate (column), given their places, is above its bound."""
    left = np.concatenate([q[:, :-2], q[:, -1:]], axis=1)  # the margin grows with both norms
    out = left @ x[:, :-1].T + 1.0
    return np.where(np.isfinite(out), out, np.inf)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products of a vector with the rows of ``x``; those beyond 64 bits stop at the ends of the range."""
    most = np.abs(q).sum() * (np.abs(x).max() if x.size else 0)
    if most < EXACT:
        return (x @ q).astype(np.int64)
    whole = [sum(int(a) * int(b) for a, b in zip(q, row)) for row in x]
    return np.array([min(max(s, _LEAST), _MOST) for s in whole], np.int64)


@dataclass
class Group:
    """Candidates of one length with their places; ``scored`` counts those whose score was worked out."""

    rids: np.ndarray
    ids: np.ndarray
    known: np.ndarray
    x: np.ndarray
    places: np.ndarray
    scored: int = 0

    def best(self, rid: int, q: np.ndarray, upper: np.ndarray, least: int | None, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, marks of ids that aren't null, and scores of the k best but for row ``rid``; none need be below ``least``."""
        upper = np.where(self.rids == rid, -np.inf, upper)
        order = np.flatnonzero(upper > -np.inf if least is None else upper >= least)
        order = order[np.argsort(-upper[order], kind="stable")]
        top, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, step = 0, STEP
        while at < len(order) and (len(best) < k or upper[order[at]] >= best[-1]):
            some = order[at : at + step]
            top, best = np.concatenate([top, some]), np.concatenate([best, products(q, self.x[some])])
            self.scored += len(some)
            first = np.lexsort((self.ids[top], ~self.known[top], ~best))[:k]  # ~ turns the order around without overflow
            top, best = top[first], best[first]
            at, step = at + step, step * 2
        return self.ids[top], self.known[top], best


def _unpack(batch: pa.RecordBatch, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """rid, vec_id, marks of ids that aren't null, and vectors of the rows of length d."""
    rows = batch.filter(pa.compute.equal(batch.column("dim"), d))
    v = rows.column("v")
    ids = rows.column("vec_id")
    return rows.column("rid").to_numpy(), ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False), v.flatten().to_numpy().reshape(len(v), d)


def _search(group: Group, pivots: Pivots, rids: np.ndarray, q: np.ndarray, least: list[int | None], k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each query: its rid and what the group has for it."""
    places = pivots.place(q)
    for i in range(0, len(q), AT_ONCE):
        bounds = upper_bounds(places[i : i + AT_ONCE], group.places)
        for j, upper in enumerate(bounds, i):
            yield int(rids[j]), *group.best(int(rids[j]), q[j], upper, least[j], k)


def exact_top_k(vectors: DataFrame, k: int = 10, scale: int = 1024, every: int = 100) -> DataFrame:
    """For each row whose vec_id is divisible by ``every``: query_id, rank, vec_id, score of its k best other rows.

    Each task holds one group of candidates and reads the queries block by block from the shared folder, so its memory
    doesn't depend on the table and no row is multiplied. A first group of rows gives each query a k-th score to begin
    with, below which no group need look; a group gives at most k rows a query, and these are merged by query.

    Nulls and ties: vectors that are null or hold a null or non-finite component take no part. Every other row is a
    candidate of every query but itself, also rows of an id that occurs again, and rows with a null vec_id, which are
    no queries and come last among ties. A repeated query id gives a result for each of its rows. Vectors meet only
    those of their own length; empty ones score 0. Scores beyond 64 bits stop there. An empty table, and one without
    queries, gives an empty result.
    """
    spark = vectors.sparkSession
    rows = stage(quantised(vectors.select("vec_id", "embedding"), scale), "vectors")
    counts = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("_n"))
    drawn = F.pmod(F.xxhash64("rid", "vec_id"), F.lit(1 << 31)) * F.col("_n") < F.lit(FIRST_GROUP << 31)
    first = rows.join(counts, "dim").filter(drawn).select(*rows.columns)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pivots of the lengths in a partition, whose rows are ordered by length."""
        pools: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for d in np.unique(b.column("dim").to_numpy()).tolist():
                pools.setdefault(d, []).append(_unpack(b, d)[3])
        for d, parts in pools.items():
            p = Pivots.choose(np.concatenate(parts)[:PIVOT_POOL], max(1, 3 * d // 4))
            packed = [pa.array([x.tobytes()], pa.binary()) for x in (p.points, p.back)]
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), *packed], ["dim", "points", "back"])

    def pivots_of(path: str) -> dict[int, Pivots]:
        out = {}
        for r in _read(path):
            for d, points, back in zip(*(r.column(c).to_pylist() for c in ("dim", "points", "back"))):
                p = np.frombuffer(points).reshape(-1, d) if d else np.zeros((0, 0))
                out[d] = Pivots(p, (p * p).sum(axis=1), np.frombuffer(back).reshape(len(p), len(p)))
        return out

    pivot_path, first_path, query_path = new_path(spark, "pivots"), new_path(spark, "first-group"), new_path(spark, "queries")
    first.write.parquet(first_path)
    first = spark.read.schema(rows.schema).parquet(first_path)
    first.repartition("dim").sortWithinPartitions("dim").mapInArrow(choose, "dim int, points binary, back binary").write.parquet(pivot_path)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries with the k-th score of the first group, if that has k other rows."""
        pivots, groups = pivots_of(pivot_path), list(_groups(_read(first_path), pivots_of(pivot_path)))
        for b in batches:
            for i in range(0, b.num_rows, QUERY_BLOCK):
                part = b.slice(i, QUERY_BLOCK)
                found: dict[int, np.ndarray] = {}
                for d, group in groups:
                    rids, _, _, q = _unpack(part, d)
                    for rid, _, _, scores in _search(group, _of(pivots, d), rids, q, [None] * len(q), k):
                        found[rid] = np.sort(np.concatenate([found.get(rid, scores[:0]), scores]))[::-1][:k]
                least = [int(found[r][-1]) if len(found.get(r, ())) == k else None for r in part.column("rid").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(least, pa.int64())], [*part.schema.names, "least"])

    queries = rows.filter(F.col("vec_id") % every == 0)
    queries.mapInArrow(begin, "rid long, vec_id long, v array<double>, dim int, least long").write.parquet(query_path)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = pivots_of(pivot_path)
        for d, group in _groups(batches, pivots):
            for block in _read(query_path):
                part = block.filter(pa.compute.equal(block.column("dim"), d))
                rids, ids, _, q = _unpack(part, d)
                out = list(_search(group, _of(pivots, d), rids, q, part.column("least").to_pylist(), k))
                if out:
                    sizes = [len(s) for *_, s in out]
                    vec = pa.array(np.concatenate([x for _, x, _, _ in out]), mask=~np.concatenate([m for _, _, m, _ in out]))
                    columns = [pa.array(np.repeat(rids, sizes)), pa.array(np.repeat(ids, sizes)), vec, pa.array(np.concatenate([s for *_, s in out]))]
                    yield pa.RecordBatch.from_arrays(columns, ["query", "query_id", "vec_id", "score"])

    met = rows.mapInArrow(meet, "query long, query_id long, vec_id long, score long")
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return met.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _read(path: str) -> Iterator[pa.RecordBatch]:
    """The rows of a Parquet folder of the shared store, QUERY_BLOCK at a time."""
    store, at = files.resolve(path)
    from pyarrow import fs

    for info in sorted(store.get_file_info(fs.FileSelector(at)), key=lambda f: f.path):
        if info.path.endswith(".parquet"):
            with store.open_input_file(info.path) as f:
                yield from pq.ParquetFile(f).iter_batches(QUERY_BLOCK)


def _of(pivots: dict[int, Pivots], d: int) -> Pivots:
    """A length without rows in the first group has no pivots: norms alone bound its scores."""
    return pivots.get(d) or Pivots(np.zeros((0, d)), np.zeros(0), np.zeros((0, 0)))


def _groups(batches: Iterator[pa.RecordBatch], pivots: dict[int, Pivots]) -> Iterator[tuple[int, Group]]:
    """The rows in groups of one length and CANDIDATE_GROUP rows at most."""
    held: dict[int, list[tuple[np.ndarray, ...]]] = {}

    def group(d: int) -> Group:
        rids, ids, known, x = (np.concatenate(c) for c in zip(*held.pop(d)))
        return Group(rids, ids, known, x, _of(pivots, d).place(x))

    for b in batches:
        for d in np.unique(b.column("dim").to_numpy()).tolist():
            rows = _unpack(b, d)
            for i in range(0, len(rows[0]), CANDIDATE_GROUP):
                part = tuple(c[i : i + CANDIDATE_GROUP] for c in rows)
                if d in held and sum(len(p[0]) for p in held[d]) + len(part[0]) > CANDIDATE_GROUP:
                    yield d, group(d)
                held.setdefault(d, []).append(part)
    for d in list(held):
        yield d, group(d)


ORACLE = """
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.rid AS query, a.vec_id AS query_id, b.vec_id, list_inner_product(a.v, b.v)::BIGINT AS score
      FROM v a JOIN v b ON a.rid <> b.rid AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id NULLS LAST)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
