"""SimHash near-dedup with a hierarchical index over fingerprints in Gray order.

All distinct fingerprints are sorted by Gray rank and cut into blocks, so that neighbours in the order share many bits.
Over each block stands a tree of groups: a node holds the bits that all fingerprints below it share, and a node further
down only adds to them. Two trees are searched for near pairs together, from the top: the differences in the bits that
two nodes share are added up on the way down, and both groups are left as soon as they are too many. The top nodes of
all blocks tell each task which other blocks it need read at all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotframe.llm import files
from slotframe.llm.common import new_path, stage, text_batches
from slotframe.llm.components import connected_components
from slotframe.llm.row_keys import keep_rows, keyed_rows

SHINGLE_WORDS = 3
SEED = 42
MAX_BITS = 3
FANOUT = 8
#: Fingerprints of a block, and the number of blocks from which on blocks grow instead; a block's name and top node go to the driver.
BLOCK, MOST_BLOCKS = 1 << 14, 1 << 16
#: Pairs of nodes that a search has before it at once, and links held before they are reduced to a forest.
FRONTIER, PAIRS = 1 << 16, 1 << 18


def fingerprint(text: bytes) -> int:
    """Bit i is 1 if it is set in over half of the shingles' hashes; no words: 0."""
    parts = text.lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    ends = np.cumsum(sizes) - 1
    k = min(SHINGLE_WORDS, len(parts))
    begins = (ends - sizes + 1)[: len(parts) - k + 1].tolist()
    stops = ends[k - 1 :].tolist()
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in zip(begins, stops)]), np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        text = b.column("text").cast(pa.large_binary())
        found = np.array([fingerprint(x.as_py() or b"") for x in text], np.uint64).view(np.int64)
        rest = b.drop_columns("text")
        yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(found)], [*rest.schema.names, "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the 64 bits as a long) of each row."""
    return text_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprints, "doc_id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of a bit pattern in the Gray code's order."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


def gray_order(fp: Column) -> Column:
    """A long that sorts as the Gray rank of the 64 bits."""
    x = fp
    for shift in (1, 2, 4, 8, 16, 32):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, shift))
    return x.bitwiseXOR(F.lit(-(1 << 63)))


class GrayTree:
    """Fingerprints in Gray order, level 0, under groups of FANOUT, groups of groups, and so on to one top node."""

    def __init__(self, fp: np.ndarray) -> None:
        low = high = fp
        self.values, self.shared = [low], [np.full(len(fp), np.uint64((1 << 64) - 1))]
        while len(low) > 1:
            at = np.arange(0, len(low), FANOUT)
            low, high = np.bitwise_and.reduceat(low, at), np.bitwise_or.reduceat(high, at)
            self.values.append(low)
            self.shared.append(~(low ^ high))

    @property
    def top(self) -> int:
        return len(self.values) - 1


@dataclass
class Search:
    """Pairs of nodes that a search has compared, and pairs of groups (not of single fingerprints) that it has left."""

    max_bits: int = MAX_BITS
    compared: int = 0
    left: int = 0

    def near(self, a: GrayTree, b: GrayTree) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions (in a, in b) of all fingerprints within max_bits of each other; within one tree, each pair once."""
        if not len(a.values[0]) or not len(b.values[0]):
            return
        zero = np.zeros(1, np.int64)
        far = np.bitwise_count((a.values[-1] ^ b.values[-1]) & a.shared[-1] & b.shared[-1]).astype(np.int64)
        if far[0] <= self.max_bits:
            yield from self._down(a, b, a.top, b.top, zero, zero, far)

    def _down(self, a: GrayTree, b: GrayTree, i: int, j: int, x: np.ndarray, y: np.ndarray, far: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Below the pairs of nodes x of a's level i and y of b's level j, which differ in ``far`` of their shared bits."""
        if a is b and i == j:
            once = x <= y if i else x < y
            x, y, far = x[once], y[once], far[once]
        if not len(x):
            return
        if i == j == 0:
            yield x, y
            return
        if len(x) > FRONTIER:
            half = len(x) // 2
            yield from self._down(a, b, i, j, x[:half], y[:half], far[:half])
            yield from self._down(a, b, i, j, x[half:], y[half:], far[half:])
            return
        shared = a.shared[i][x] & b.shared[j][y]
        first = i >= j
        tree, level, nodes = (a, i, x) if first else (b, j, y)
        child = (nodes[:, None] * FANOUT + np.arange(FANOUT)).ravel()
        there = child < len(tree.values[level - 1])
        up = np.repeat(np.arange(len(nodes)), FANOUT)[there]
        child = child[there]
        if first:
            i, x, y = i - 1, child, y[up]
        else:
            j, x, y = j - 1, x[up], child
        fresh = a.shared[i][x] & b.shared[j][y] & ~shared[up]
        far = far[up] + np.bitwise_count((a.values[i][x] ^ b.values[j][y]) & fresh)
        keep = far <= self.max_bits
        self.compared += len(keep)
        self.left += 0 if i == j == 0 else int(len(keep) - keep.sum())
        yield from self._down(a, b, i, j, x[keep], y[keep], far[keep])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that link what the pairs link: each value and the smallest of its component."""
    names, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(names))
    while True:
        rx, ry = root[x], root[y]
        low, high = np.minimum(rx, ry), np.maximum(rx, ry)
        apart = low != high
        if not apart.any():
            break
        np.minimum.at(root, high[apart], low[apart])
        while (root != root[root]).any():
            root = root[root]
    moved = root != np.arange(len(names))
    return names[moved], names[root[moved]]


@dataclass(frozen=True)
class Blocks:
    """The blocks of all fingerprints in Gray order: their files in ``path``, and the top node of each."""

    path: str
    names: list[str]
    value: np.ndarray
    shared: np.ndarray

    def read(self, i: int) -> np.ndarray:
        return np.frombuffer(files.read_bytes(f"{self.path}/{self.names[i]}"), "<u8")

    def near(self, i: int, max_bits: int) -> np.ndarray:
        """The blocks that may hold fingerprints near those of block i; of two such blocks one finds the other."""
        n = len(self.names)
        ahead = (np.arange(n) - i) % n
        mine = (2 * ahead < n) | (2 * ahead == n) & (i < np.arange(n))
        return np.flatnonzero(mine & (np.bitwise_count((self.value ^ self.value[i]) & self.shared & self.shared[i]) <= max_bits))


def write_blocks(distinct: DataFrame) -> Blocks:
    """Sort the fingerprints (fp, each once) of the whole table by Gray rank and write them as blocks to the shared folder."""
    path, n = new_path(distinct.sparkSession, "gray-blocks"), distinct.count()
    size = max(BLOCK, -(-n // MOST_BLOCKS))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        done = 0

        def block(fp: np.ndarray) -> pa.RecordBatch:
            nonlocal done
            name = files.part_name(TaskContext.get().partitionId(), done, ".fp")
            files.write_bytes(f"{path}/{name}", fp.astype("<u8").tobytes())
            done += 1
            low, high = np.bitwise_and.reduce(fp), np.bitwise_or.reduce(fp)
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array(np.array([low, ~(low ^ high)]).view(np.int64)[:1]), pa.array(np.array([low, ~(low ^ high)]).view(np.int64)[1:])], ["name", "value", "shared"])

        for b in batches:
            held.append(b.column("fp").to_numpy().view(np.uint64))
            while sum(map(len, held)) >= size:
                every = np.concatenate(held)
                yield block(every[:size])
                held = [every[size:]]
        if sum(map(len, held)):
            yield block(np.concatenate(held))

    ordered = distinct.select("fp", gray_order(F.col("fp")).alias("g")).repartitionByRange(max(1, -(-n // size)), "g").sortWithinPartitions("g")
    found = ordered.select("fp").mapInArrow(write, "name string, value long, shared long").collect()  # a row for each block
    as_bits = lambda c: np.array([r[c] for r in found], np.int64).view(np.uint64)
    return Blocks(path, [r["name"] for r in found], as_bits("value"), as_bits("shared"))


def linked_fingerprints(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Edges (u, v) that connect all fingerprints (fp, each once) within max_bits of each other; no more than a forest a task."""
    spark = distinct.sparkSession
    blocks = spark.sparkContext.broadcast(write_blocks(distinct))  # at most some 2 * MOST_BLOCKS names and top nodes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, search = blocks.value, Search(max_bits)
        for i in (i for b in batches for i in b.column("id").to_pylist()):
            own = GrayTree(known.read(i))
            held: list[tuple[np.ndarray, np.ndarray]] = []
            size = 0
            for j in known.near(i, max_bits):
                other = own if i == j else GrayTree(known.read(j))
                for x, y in search.near(own, other):
                    held.append((own.values[0][x].view(np.int64), other.values[0][y].view(np.int64)))
                    size += len(x)
                    if size >= PAIRS:
                        held = [forest(np.concatenate([p for p, _ in held]), np.concatenate([q for _, q in held]))]
                        size = len(held[0][0])
            if size:
                u, v = forest(np.concatenate([p for p, _ in held]), np.concatenate([q for _, q in held]))
                for k in range(0, len(u), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(u[k : k + (1 << 16)]), pa.array(v[k : k + (1 << 16)])], ["u", "v"])

    n = len(blocks.value.names)
    return spark.range(0, n, 1, max(1, n)).mapInArrow(run, "u long, v long").distinct()


def near_copies(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, fingerprint (16 hex digits), component_id.

    Equal texts and equal fingerprints are one node of the graph, so copies cost nothing beyond their own hashing.
    Every link between different fingerprints is found; components are of all links.

    Nulls and ties: null and empty texts, and texts of white space, have the fingerprint zero and are linked like
    others; a null doc_id never names a component unless the component has no other id; repeated rows each give a
    row. An empty table gives an empty result. Only the two columns named are read.
    """
    rows = stage(fingerprints(docs), "fingerprints")
    names = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    linked = stage(connected_components(linked_fingerprints(names.select("fp"))), "components")
    named = names.join(linked, names["fp"] == linked["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    lookup = stage(named.join(ids, "root").select("fp", "component_id"), "fingerprint-components")
    return rows.join(lookup, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id, nulls last, then of the smallest text hash.

    Rows are told apart by doc_id and text, so null and repeated ids with different texts each count for the component
    that their own text is in. Of rows that are equal in both, that with the smallest digest of all columns stays.
    """
    rows = stage(text_batches(keyed_rows(docs, F.col("text"))).mapInArrow(_fingerprints, "doc_id long, key binary, rid long, fp long"), "fingerprints")
    first = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "key", "rid")
    names = stage(rows.groupBy("fp").agg(F.min(first).alias("least")), "distinct-fingerprints")
    linked = stage(connected_components(linked_fingerprints(names.select("fp"))), "components")
    named = names.join(linked, names["fp"] == linked["node"], "left").select("least", F.coalesce("root", "fp").alias("root"))
    keep = named.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.rid").alias("rid"), F.lit(True).alias("kept"))
    return keep_rows(docs, rows.join(keep, "rid", "left").select("doc_id", "key", F.coalesce("kept", F.lit(False)).alias("kept")))
