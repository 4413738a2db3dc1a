"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotframe.llm.common import text_batches

#: Texts are scored in runs of about so many bytes.
RUN_BYTES = 1 << 19
_BASE = 1_099_511_628_211
_MIX = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.concatenate([[1], np.full(4095, _BASE)]).astype(np.uint64), dtype=np.uint64)


def _classes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    kind = np.full(256, 2, np.uint8)  # signs
    kind[[32, *range(9, 14)]] = 0  # white space
    kind[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1  # letters, digits, and all beyond ASCII
    lower = np.arange(256, dtype=np.uint64)
    lower[65:91] += 32
    upper = np.zeros(256, np.int64)
    upper[65:91] = 1
    return kind, lower, upper


_KIND, _LOWER, _UPPER = _classes()


@dataclass(frozen=True)
class Settings:
    """max_rows bounds the labelled rows that are learnt from, those of the smallest id hashes; scoring has no bound."""

    bits: int = 18
    max_rows: int = 8192
    least_updates: int = 16384
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.0005
    l2: float = 0.01
    scale: float = 8.0
    threshold: float = 0.3
    folds: int = 5


def _mixed(h: np.ndarray, salt: int, bits: int) -> np.ndarray:
    h = (h ^ np.uint64(salt)) * _MIX
    h ^= h >> np.uint64(29)
    return ((h * _MIX) >> np.uint64(64 - bits)).astype(np.int64)


def features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashed n-grams of the texts data[offsets[i]:offsets[i+1]], and the tokens each text has.

    Tokens are runs of letters and runs of signs. The n-grams are single words, word pairs, and one to three token
    shapes; a shape is a sign run itself, or a word's use of capitals and whether it repeats the token before. Each
    array has an index for each token, -1 where an n-gram would reach back into another text.
    """
    n = len(data)
    kind = _KIND[data]
    new = np.empty(n + 1, bool)
    new[0], new[n] = True, True
    new[1:n] = kind[1:] != kind[:-1]
    new[offsets] = True
    at = np.flatnonzero(new)
    starts, ends = at[:-1], at[1:]
    real = kind[starts] != 0 if n else np.zeros(0, bool)
    starts, ends = starts[real], ends[real]
    owner = np.searchsorted(offsets, starts, "right") - 1
    counts = np.bincount(owner, minlength=len(offsets) - 1)
    if not len(starts):
        return [np.zeros(0, np.int64)] * 5, counts
    size = ends - starts
    first = np.cumsum(size) - size
    rel = np.arange(int(size.sum())) - np.repeat(first, size)
    where = np.repeat(starts, size) + rel
    byte = data[where]
    h = np.add.reduceat((_LOWER[byte] + np.uint64(1)) * _POWERS[rel & 4095], first)
    caps = np.add.reduceat(_UPPER[byte], first)
    same = lambda k: np.concatenate([np.zeros(min(k, len(owner)), bool), owner[k:] == owner[:-k]])
    one, two = same(1), same(2)
    back = lambda x, k: np.concatenate([x[:k], x[:-k]])[: len(x)]
    shape = np.where(caps == 0, 1, np.where(caps == 1, 2, np.where(caps * 2 > size, 3, 4))).astype(np.uint64)
    shape = np.where(one & (h == back(h, 1)), np.uint64(5), shape)
    shape = np.where(kind[starts] == 2, h | np.uint64(1 << 40), shape)
    s1, s2 = back(shape, 1) * np.uint64(31), back(shape, 2) * np.uint64(961)
    return [
        _mixed(h, 1, bits),
        np.where(one, _mixed(h * np.uint64(3) + back(h, 1), 2, bits), -1),
        _mixed(shape, 3, bits),
        np.where(one, _mixed(shape + s1 * _MIX, 4, bits), -1),
        np.where(two, _mixed(shape + s1 * _MIX + s2 * (_MIX >> np.uint64(7)), 5, bits), -1),
    ], counts


def _runs(text: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes, offsets and row numbers of the texts of ``text``, about RUN_BYTES at a time; null is empty.

    A longer text comes in pieces cut at white space (or, without any, at RUN_BYTES), so its memory is bounded too;
    no n-gram spans a cut. Where a text is cut depends on itself alone.
    """
    text = text.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] else np.zeros(0, np.uint8)
    i = 0
    while i < len(text):
        start, end = int(offsets[i]), int(offsets[i + 1])
        if end - start > RUN_BYTES:
            while start < end:
                stop = min(end, start + RUN_BYTES)
                white = np.flatnonzero(_KIND[data[start:stop]] == 0) if stop < end else ()
                stop = start + int(white[-1]) + 1 if len(white) else stop
                yield data[start:stop], np.array([0, stop - start]), np.array([i])
                start = stop
            i += 1
            continue
        j = int(np.searchsorted(offsets, start + RUN_BYTES, "right")) - 1
        yield data[start : offsets[j]], offsets[i : j + 1] - start, np.arange(i, j)
        i = j


def margins(text: pa.Array, weights: np.ndarray, bias: float, s: Settings) -> np.ndarray:
    """The linear score of each text: for each kind of n-gram, the sum of its weights by the number of tokens."""
    sums, tokens = np.zeros(len(text)), np.zeros(len(text))
    padded = np.append(weights, np.float32(0))  # -1 finds nothing
    for data, offsets, rows in _runs(text):
        grams, counts = features(data, offsets, s.bits)
        has = np.flatnonzero(counts)
        begin = (np.cumsum(counts) - counts)[has]
        np.add.at(tokens, rows, counts)
        for idx in grams if len(has) else ():
            np.add.at(sums, rows[has], np.add.reduceat(padded[idx].astype(np.float64), begin))
    return bias + s.scale * sums / np.maximum(tokens, 1)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], s: Settings) -> tuple[np.ndarray, float]:
    """Follow the regularised leader over (indexes, values, label) rows, in as many passes as least_updates needs."""
    z, n = np.zeros(1 << s.bits), np.zeros(1 << s.bits)
    zb = nb = bias = 0.0

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= s.l1, 0.0, -(zi - np.sign(zi) * s.l1) / ((s.beta + np.sqrt(ni)) / s.alpha + s.l2))

    for _ in range(max(1, -(-s.least_updates // max(1, len(rows))))) if rows else ():
        for idx, x, y in rows:
            zi, ni = z[idx], n[idx]
            w = weights(zi, ni)
            bias = -zb / ((s.beta + np.sqrt(nb)) / s.alpha + s.l2)
            g = 1 / (1 + np.exp(-np.clip(bias + w @ x, -35, 35))) - y
            gx = g * x
            step = (np.sqrt(ni + gx * gx) - np.sqrt(ni)) / s.alpha
            z[idx], n[idx] = zi + gx - step * w, ni + gx * gx
            zb, nb = zb + g - (np.sqrt(nb + g * g) - np.sqrt(nb)) / s.alpha * bias, nb + g * g
    return weights(z, n).astype(np.float32), float(bias)


def _trainer(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for b in (b for b in batches if b.num_rows):
            own: list[list[np.ndarray]] = [[] for _ in range(b.num_rows)]
            tokens = np.zeros(b.num_rows)
            for data, offsets, at in _runs(b.column("text")):
                grams, counts = features(data, offsets, s.bits)
                np.add.at(tokens, at, counts)
                cuts = np.concatenate([[0], np.cumsum(counts)])
                for i, row in enumerate(at):
                    own[row] += [g[cuts[i] : cuts[i + 1]].astype(np.int32) for g in grams]
            found = []
            for row, parts in enumerate(own):
                every = np.concatenate(parts)
                idx, times = np.unique(every[every >= 0], return_counts=True)
                found.append((idx, (s.scale * times / max(1, tokens[row])).astype(np.float32)))
            cuts = np.cumsum([0, *(len(idx) for idx, _ in found)])
            idx, x = (np.concatenate(c) for c in zip(*found))  # few large arrays go back to the system when freed
            rows += [(idx[a:z], x[a:z], y) for a, z, y in zip(cuts, cuts[1:], b.column("quality").to_pylist())]
        w, bias = train(rows, s)
        idx = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(idx, -1)), pa.array(np.append(w[idx], bias).astype(np.float64))], ["i", "w"])

    return run


def fold(column: str):
    """crc32 of the id as text, modulo 5."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> tuple[np.ndarray, float]:
    """Weights and bias, learnt from up to ``max_rows`` labelled rows outside the held-out fold, in one task."""
    learn = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (fold("doc_id") != 0)).select("doc_id", "quality", F.xxhash64("doc_id").alias("order"))
    sample = F.broadcast(learn.orderBy("order", "doc_id", "quality").limit(s.max_rows))  # max_rows rows of 20 bytes
    rows = text_batches(docs).select("doc_id", "text").join(sample, "doc_id").repartition(1).sortWithinPartitions("order", "doc_id", "quality")
    found = rows.select("text", "quality").mapInArrow(_trainer(s), "i long, w double").collect()  # 2 ** bits weights at most
    weights = np.zeros(1 << s.bits, np.float32)
    bias = 0.0
    for i, w in found:
        if i < 0:
            bias = w
        else:
            weights[i] = w
    return weights, bias


def score_quality(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted.

    Only the text decides a score. Nulls and ties: a null or empty text gets the score of the bias alone; a null
    doc_id is in no fold, so it isn't held out; labels that are null or not 0 or 1, and labels without a document,
    teach nothing; a repeated label counts again. With no labels at all every score is 0.5. An empty table gives an
    empty result. Other columns aren't read.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(fit(docs, labels, s))  # 2 ** bits floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = model.value
        for b in batches:
            m = np.clip(margins(b.column("text"), weights, bias, s), -35, 35)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(1 / (1 + np.exp(-m)))], ["doc_id", "score"])

    scored = text_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= s.threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``docs`` without the rows that the classifier rejects; each row is judged by its own text."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, s))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = model.value
        for b in batches:
            m = np.clip(margins(b.column("text"), weights, bias, s), -35, 35)
            yield b.filter(pa.array(1 / (1 + np.exp(-m)) >= s.threshold))

    return text_batches(docs).mapInArrow(run, docs.schema)
