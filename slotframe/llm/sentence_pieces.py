"""SentencePiece encoding and decoding by suffix-array matching.

The words that a batch adds are laid end to end and indexed by a suffix array as deep as the longest piece. A binary
search finds the range of suffixes that begin with a piece, for every piece of the model; each suffix in it is an
edge from its position over the piece. Edges are sorted by position. What is relaxed over them is the model's own
rule: a pair-merge model joins, in each word, the two neighbours whose union is the edge of the best score, the
leftmost of equals, until no edge joins neighbours. (The largest sum of scores would be another segmentation.)
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotframe.llm.common import text_batches
from slotframe.llm.word_cache import WordCache, gather, runs

SPACE = "▁"
#: Characters of new words that are indexed at once; words longer than LONG are relaxed one by one.
INDEX_CHARS, LONG = 1 << 20, 64
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
_NONE = np.int64(1) << 40


@dataclass(frozen=True)
class Model:
    pieces: list[str]
    scores: np.ndarray
    kinds: np.ndarray
    byte_ids: list[int]
    splits: bool
    longest: int
    normal: np.ndarray
    chars: np.ndarray
    rank: np.ndarray
    kind: type


@cache
def load(path: str) -> Model:
    """The model file's pieces, by the library that reads it. Only pair-merge models without normalisation rules."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.vocab_size()
    pieces = [sp.id_to_piece(i) for i in range(n)]
    scores = np.array([sp.get_score(i) for i in range(n)])
    kinds = np.array([BYTE if sp.is_byte(i) else UNKNOWN if sp.is_unknown(i) else CONTROL if sp.is_control(i) or sp.is_unused(i) else NORMAL for i in range(n)])
    byte_ids = [-1] * 256
    for i in np.flatnonzero(kinds == BYTE):
        byte_ids[int(pieces[i][1:-1], 16)] = int(i)
    normal = np.flatnonzero(kinds == NORMAL)
    longest = max((len(pieces[i]) for i in normal), default=1)
    chars = np.zeros((len(normal), longest), np.uint32)
    for row, i in enumerate(normal):
        chars[row, : len(pieces[i])] = [ord(c) for c in pieces[i]]
    rank = np.full(n, _NONE)
    _, place = np.unique(-scores[normal], return_inverse=True)  # equal scores, equal rank
    rank[normal] = place
    splits = not any(re.search(f"[^{SPACE}]{SPACE}", pieces[i]) for i in normal)
    return Model(pieces, scores, kinds, byte_ids, splits, longest, normal, chars, rank, np.uint16 if n <= 1 << 16 else np.uint32)


#: Texts that a model with normalisation rules, other spacing or another merge rule would encode differently.
_PROBES = ("  a  b ", " x\t\u00a0y\u3000z ", "ﬁ½ ℌ e\u0301 \x01", "a▁b", "0123456789 " * 3)


@cache
def check(path: str) -> None:
    """Raise where the file isn't a model of the kind that is built here, as its own library tells on probe texts."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    m = load(path)
    long = sorted((m.pieces[i].replace(SPACE, " ").strip() for i in m.normal), key=lambda x: (-len(x), x))[:256]
    texts = [*_PROBES, " ".join(long), "".join(long), " ".join(x[1:] + x[:1] for x in long)]
    got = [x.tolist() for ids, counts in encode_texts(pa.array(texts), path) for x in np.split(ids, np.cumsum(counts)[:-1])]
    if got != sp.encode(texts):
        raise ValueError(f"{path}: only pair-merge models without normalisation rules are supported")


class Edges:
    """All occurrences of the model's pieces in the indexed text, by position and then length."""

    def __init__(self, text: np.ndarray, m: Model) -> None:
        """``text``: code points, 0 between words."""
        alphabet = np.unique(text)
        bits = max(1, int(len(alphabet)).bit_length())
        depth = max(1, 63 // bits)
        code = np.searchsorted(alphabet, text).astype(np.uint64) + np.uint64(1)
        code[text == 0] = 0
        n = len(text)
        levels = -(-m.longest // depth)
        padded = np.concatenate([code, np.zeros(levels * depth + depth, np.uint64)])
        packed = np.zeros(n + levels * depth, np.uint64)
        for k in range(depth):
            packed = (packed << np.uint64(bits)) | padded[k : k + len(packed)]
        keys = [packed[depth * j : depth * j + n] for j in range(levels)]
        rank = keys[-1]
        for key in reversed(keys[:-1]):  # suffixes in order of their first levels * depth characters
            deeper = np.argsort(rank, kind="stable")
            order = deeper[np.argsort(key[deeper], kind="stable")]
            moved = np.concatenate([[False], (key[order][1:] != key[order][:-1]) | (rank[order][1:] != rank[order][:-1])])
            rank = np.zeros(n, np.uint64)
            rank[order] = np.cumsum(moved).astype(np.uint64)
        suffixes = np.argsort(rank, kind="stable")
        low, high = self._ranges(m, alphabet, bits, depth, [k[suffixes] for k in keys])
        count = high - low
        found = np.flatnonzero(count)
        count, low = count[found], low[found]
        each = np.repeat(low, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        at = suffixes[each]
        size = (m.chars != 0).sum(axis=1)[found]
        piece = m.normal[found]
        edges = np.sort((at << 26) | np.repeat((size << 20) | piece, count))
        self.piece = edges & 0xFFFFF
        size, at = (edges >> 20) & 63, edges >> 26
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
        self.first, self.sizes = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.uint64)
        if len(at):
            self.first[at[first]] = first
            self.sizes[at[first]] = np.bitwise_or.reduceat(np.uint64(1) << size.astype(np.uint64), first)

    @staticmethod
    def _ranges(m: Model, alphabet: np.ndarray, bits: int, depth: int, keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """For each piece, the range of suffixes that begin with it."""
        spot = np.minimum(np.searchsorted(alphabet, m.chars), len(alphabet) - 1)
        known = (alphabet[spot] == m.chars) | (m.chars == 0)
        code = np.where(m.chars == 0, 0, spot + 1).astype(np.uint64)
        size = (m.chars != 0).sum(axis=1)
        usable = known.all(axis=1)
        low, high = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        for j, key in enumerate(keys):
            part = code[:, j * depth : (j + 1) * depth]
            want = np.zeros(len(size), np.uint64)
            for k in range(depth):
                want = (want << np.uint64(bits)) | (part[:, k] if k < part.shape[1] else np.uint64(0))
            left = np.clip(size - j * depth, 0, depth)
            most = want | ((np.uint64(1) << (np.uint64(bits) * (depth - left).astype(np.uint64))) - np.uint64(1))
            if j == 0:
                low, high = np.searchsorted(key, want, "left"), np.searchsorted(key, most, "right")
                low, high = np.where(usable, low, 0), np.where(usable, high, 0)
            else:  # few pieces are so long
                for i in np.flatnonzero((left > 0) & (high > low)):
                    a, z = low[i], high[i]
                    low[i], high[i] = a + np.searchsorted(key[a:z], want[i], "left"), a + np.searchsorted(key[a:z], most[i], "right")
        return low, np.maximum(low, high)

    def find(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The piece over each span, or -1: its place is the number of shorter edges from there."""
        sizes, wide = self.sizes[at], size > 62
        bit = np.uint64(1) << np.where(wide, 63, size).astype(np.uint64)
        there = (sizes & bit) != 0
        place = self.first[at] + np.bitwise_count(sizes & (bit - np.uint64(1)))
        return np.where(there, self.piece[np.where(there, place, 0)] if len(self.piece) else -1, -1)


def _relax_all(edges: Edges, starts: np.ndarray, ends: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge in all words at once, one merge a word and round. Returns (word, start, end) of every token."""
    size = ends - starts
    word = np.repeat(np.arange(len(starts)), size)
    begin = np.repeat(starts, size) + np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
    end = begin + 1
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def ranks(k: np.ndarray) -> np.ndarray:
        """Of the pairs of tokens k and k + 1."""
        piece = edges.find(begin[k], end[k + 1] - begin[k])
        return np.where(piece >= 0, m.rank[piece], _NONE)

    rank = np.full(len(word), _NONE)
    pairs = np.flatnonzero(word[1:] == word[:-1])
    rank[pairs] = ranks(pairs)
    while len(word):
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        best = np.minimum.reduceat((rank << 21) | np.arange(len(word)), first)
        alive = best < (_NONE << 21)
        if not alive.all():
            span = np.diff(np.append(first, len(word)))
            stay = np.repeat(alive, span)
            done.append((word[~stay], begin[~stay], end[~stay]))
            shift = np.cumsum(np.where(alive, 0, span)) - np.where(alive, 0, span)
            best = (best - shift)[alive]
            word, begin, end, rank = word[stay], begin[stay], end[stay], rank[stay]
            if not len(word):
                break
        k = best & ((1 << 21) - 1)
        end[k] = end[k + 1]
        keep = np.ones(len(word), bool)
        keep[k + 1] = False
        word, begin, end, rank = word[keep], begin[keep], end[keep], rank[keep]
        k = k - np.arange(len(k))  # one token went before each later k
        rank[k] = _NONE
        after = k[(k + 1 < len(word)) & (word[np.minimum(k + 1, len(word) - 1)] == word[k])]
        before = k[(k > 0) & (word[k - 1] == word[k])] - 1
        rank[after] = ranks(after)
        rank[before] = ranks(before)
    return tuple(np.concatenate(x) for x in zip(*done)) if done else (np.zeros(0, np.int64),) * 3  # type: ignore[return-value]


def _relax_one(edges: Edges, start: int, stop: int, m: Model) -> list[tuple[int, int]]:
    """The same for one long word, with a heap: its time is little more than its length."""
    n = stop - start
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    sizes, first = edges.sizes[start:stop].tolist(), edges.first[start:stop].tolist()
    heap: list[tuple[int, int, int]] = []

    def push(a: int) -> None:
        b = after[a]
        if b < n:
            size = after[b] - a
            if size < 63 and sizes[a] >> size & 1:
                piece = edges.piece[first[a] + (sizes[a] & ((1 << size) - 1)).bit_count()]
                heapq.heappush(heap, (int(m.rank[piece]), a, size))

    for a in range(n):
        push(a)
    while heap:
        _, a, size = heapq.heappop(heap)
        if not alive[a] or after[a] >= n or after[after[a]] - a != size:
            continue
        b = after[a]
        alive[b] = False
        after[a] = after[b]
        if after[a] < n:
            before[after[a]] = a
        push(a)
        if before[a] >= 0:
            push(before[a])
    return [(start + a, start + after[a]) for a in range(n) if alive[a]]


def segment(units: list[str], m: Model) -> list[bytes]:
    """The ids of each unit, packed as ``m.kind``."""
    text = np.frombuffer(("\0".join(units) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter(map(len, units), np.int64, len(units))
    starts = np.cumsum(size + 1) - size - 1
    edges = Edges(text, m)
    short = np.flatnonzero(size <= LONG)
    word, begin, end = _relax_all(edges, starts[short], (starts + size)[short], m)
    word = short[word]
    long_tokens = [(i, a, z) for i in np.flatnonzero(size > LONG) for a, z in _relax_one(edges, int(starts[i]), int(starts[i] + size[i]), m)]
    if long_tokens:
        w, a, z = (np.array(x, np.int64) for x in zip(*long_tokens))
        word, begin, end = np.concatenate([word, w]), np.concatenate([begin, a]), np.concatenate([end, z])
    order = np.argsort(begin, kind="stable")
    word, begin, end = word[order], begin[order], end[order]
    ids = edges.find(begin, end - begin)
    strange = np.flatnonzero(ids < 0)  # single characters without a piece become bytes
    if len(strange):
        spelled = [[m.byte_ids[b] for b in chr(text[begin[i]]).encode("utf-8", "replace")] for i in strange]
        times = np.ones(len(ids), np.int64)
        times[strange] = [len(x) for x in spelled]
        at = (np.cumsum(times) - times)[strange]
        ids, word = np.repeat(ids, times), np.repeat(word, times)
        for a, x in zip(at, spelled):
            ids[a : a + len(x)] = x
    cuts = (np.searchsorted(word, np.arange(len(units) + 1)) * np.dtype(m.kind).itemsize).tolist()
    packed = ids.astype(m.kind).tobytes()
    return [packed[a:z] for a, z in zip(cuts, cuts[1:])]


_caches: dict[str, WordCache] = {}


def _marked(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with the space before each that the model adds; an empty text has none."""
    full = offsets[1:] > offsets[:-1]
    return np.insert(data, offsets[:-1][full], 32), offsets + np.concatenate([[0], np.cumsum(full)])


def _learn(units: list[bytes], m: Model) -> list[bytes]:
    """The ids of each unit, as many units indexed at once as INDEX_CHARS allows."""
    texts = [u.decode().replace(" ", SPACE) for u in units]
    out: list[bytes] = []
    begin = size = 0
    for i, t in enumerate(texts):
        if size + len(t) > INDEX_CHARS and i > begin:
            out += segment(texts[begin:i], m)
            begin, size = i, 0
        size += len(t) + 1
    return out + segment(texts[begin:], m)


def _encoded(text: pa.Array, path: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of the texts: all ids, the number of ids of each text, the marked texts and their offsets."""
    m, cache_of = load(path), _caches.setdefault(path, WordCache())
    for data, offsets in runs(text):
        whole = data, offsets = _marked(data, offsets)
        if SPACE.encode() in data.tobytes():  # the mark itself is a space like others
            texts = [data[a:z].tobytes().replace(SPACE.encode(), b" ") for a, z in zip(offsets, offsets[1:])]
            data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
        cut = np.zeros(len(data) + 1, bool)
        if m.splits:
            cut[:-1] = data == 32
            cut[1:-1] &= data[:-1] != 32
        cut[offsets] = False
        yield *gather(data, offsets, np.flatnonzero(cut), lambda units: cache_of.encode(units, lambda new: _learn(new, m)), b"", m.kind), *whole


def encode_texts(text: pa.Array, path: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of the texts: all ids, and the number of ids of each text; an empty text has none."""
    for ids, counts, _, _ in _encoded(text, path):
        yield ids, counts


@cache
def _spelling(path: str) -> list[bytes]:
    m = load(path)
    out = []
    for piece, kind in zip(m.pieces, m.kinds):
        if kind == BYTE:
            out.append(bytes([int(piece[1:-1], 16)]))
        else:
            out.append(b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else piece.replace(SPACE, " ").encode())
    return out


@cache
def _spelled(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The spellings in a row, and where each begins and how long it is."""
    size = np.array([len(x) for x in _spelling(path)], np.int64)
    return np.frombuffer(b"".join(_spelling(path)), np.uint8), np.cumsum(size) - size, size


def spell(ids: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes that the ids stand for, in a row, and where those of each id end."""
    flat, begin, size = _spelled(path)
    length = size[ids]
    upto = np.cumsum(length)
    return flat[np.repeat(begin[ids] - upto + length, length) + np.arange(int(upto[-1]) if len(ids) else 0)], upto


def decode_ids(ids: list[int], path: str) -> str:
    """The text of the ids, without the space that encoding puts before it."""
    text = b"".join(map(_spelling(path).__getitem__, ids)).decode("utf-8", "replace")
    return text[1:] if text[:1] == " " else text


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array<int>) of each row of ``docs`` (doc_id, text). Null and empty texts have no ids."""
    check(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = 0
            for ids, counts in encode_texts(b.column("text"), path):
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(done, len(counts)), lists], ["doc_id", "ids"])
                done += len(counts)

    return text_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id and text of each row of ``tokens`` (doc_id, ids); null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                texts = [decode_ids(x or [], path) for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode each row of ``docs``: doc_id, n_tokens, ids_crc32 (of 32-bit little-endian ids), restored.

    ``restored`` tells whether decoding gives the text back; it doesn't where the text itself holds the model's mark
    for a space. Nulls and ties: null and empty texts have no tokens, crc 0, and are restored as empty; null ids are
    passed on, repeated rows are each encoded. An empty table gives an empty result. No shuffle.
    """
    check(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = 0
            for ids, counts, data, offsets in _encoded(b.column("text"), path):
                ends = np.cumsum(counts)
                begins = ends - counts
                wide = memoryview(ids.astype("<u4")).cast("B")
                back, upto = spell(ids, path)
                upto = np.concatenate([[0], upto])
                back, texts = memoryview(back), memoryview(data)
                same = [back[a:z] == texts[p:q] for a, z, p, q in zip(upto[begins].tolist(), upto[ends].tolist(), offsets.tolist(), offsets[1:].tolist())]
                crcs = [zlib.crc32(wide[4 * a : 4 * z]) for a, z in zip(begins.tolist(), ends.tolist())]
                columns = [pa.array(counts), pa.array(crcs, pa.int64()), pa.array(same)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(done, len(counts)), *columns], ["doc_id", "n_tokens", "ids_crc32", "restored"])
                done += len(counts)

    return text_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, restored boolean")
