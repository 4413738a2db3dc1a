"""Token ids in binary files: canonical length-limited Huffman codes, decoded by table in independent blocks.

A table of files is a folder with ``codes.bin`` (a code length for each id, as bytes), part files in ascending
doc_id order, and a manifest that lists the parts with the number of ids in each. A part is, little-endian:
magic, rows, ids, bits, ids a block (5 x u64); doc_id (i64) and null mark (u8) of each row; ids of each row (u32);
the bit offset of each block (u64); the bits, first bit highest, padded to 8 bytes and 8 more.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import compress
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from slotframe.llm import files
from slotframe.llm.common import new_path, stage, text_batches
from slotframe.llm.word_cache import WordCache, gather, runs

MAGIC = 0x3146554853444954
BLOCK_IDS = 512
#: A part is closed beyond so many ids.
PART_IDS = 4 << 20
END_ID = 2
SHORTEST_LIMIT = 16


# ---- codes


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Bits of each symbol's code, at most ``limit``, least in total (package-merge); 0 for symbols that don't occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError("more symbols than codes")
    used = used[np.argsort(counts[used], kind="stable")]
    weights = counts[used].astype(np.float64)
    leaf = [np.ones(len(weights), bool)]
    merged = weights
    for _ in range(limit - 1):
        even = len(merged) // 2 * 2
        both = np.concatenate([weights, merged[0:even:2] + merged[1:even:2]])
        order = np.argsort(both, kind="stable")
        merged = both[order]
        leaf.append(order < len(weights))
    take = 2 * len(weights) - 2
    for marks in reversed(leaf):
        leaves = int(marks[:take].sum())
        out[used[:leaves]] += 1
        take = 2 * (take - leaves)
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by length, then by symbol."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    sizes = lengths[order].astype(np.int64)
    top = int(sizes.max()) if len(sizes) else 0
    steps = np.left_shift(np.int64(1), top - sizes)
    codes = np.zeros(len(lengths), np.uint64)
    codes[order] = np.right_shift(np.cumsum(steps) - steps, top - sizes).astype(np.uint64)
    return codes


@dataclass(frozen=True)
class Codes:
    lengths: np.ndarray
    codes: np.ndarray
    top: int
    symbol_at: np.ndarray
    length_at: np.ndarray

    @staticmethod
    def of(lengths: np.ndarray) -> Codes:
        codes, top = canonical(lengths), max(1, int(lengths.max(initial=0)))
        symbol_at, length_at = np.zeros(1 << top, np.uint32), np.zeros(1 << top, np.int64)
        used = np.flatnonzero(lengths)
        order = used[np.argsort(codes[used] << (np.uint64(top) - lengths[used].astype(np.uint64)), kind="stable")]
        spans = 1 << (top - lengths[order].astype(np.int64))
        n = int(spans.sum())
        symbol_at[:n], length_at[:n] = np.repeat(order.astype(np.uint32), spans), np.repeat(lengths[order].astype(np.int64), spans)
        return Codes(lengths, codes, top, symbol_at, length_at)


def encode_bits(ids: np.ndarray, c: Codes) -> tuple[np.ndarray, np.ndarray, int]:
    """The bits as bytes, the bit offset of each block, the number of bits."""
    size = c.lengths[ids].astype(np.int64)
    if len(ids) and not size.all():
        raise ValueError("an id has no code")
    end = np.cumsum(size)
    begin, bits = end - size, int(end[-1]) if len(ids) else 0
    out = np.zeros(bits // 64 + 2, np.uint64)
    if len(ids):
        code, word = c.codes[ids], begin >> 6
        room = 64 - (begin & 63) - size
        fits = room >= 0
        here = np.where(fits, code << np.maximum(room, 0).astype(np.uint64), code >> np.maximum(-room, 0).astype(np.uint64))
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        out[word[first]] |= np.bitwise_or.reduceat(here, first)
        over = np.flatnonzero(~fits)
        out[word[over] + 1] |= code[over] << (64 + room[over]).astype(np.uint64)
    return out.astype(">u8").view(np.uint8), begin[::BLOCK_IDS].astype(np.uint64), bits


def decode_bits(data: np.ndarray, offsets: np.ndarray, n: int, block: int, c: Codes) -> np.ndarray:
    """``n`` ids; all blocks are read abreast, an id of each at a time."""
    out = np.zeros((len(offsets), block), np.uint32)
    at = offsets.astype(np.int64)
    mask, wide = np.uint32((1 << c.top) - 1), 32 - c.top
    for i in range(min(block, n)):
        if i == n - (len(offsets) - 1) * block:  # the last block is at its end
            at = at[:-1]
        byte = at >> 3
        four = (data[byte].astype(np.uint64) << np.uint64(32)) | (data[byte + 1].astype(np.uint64) << np.uint64(24)) | (data[byte + 2].astype(np.uint64) << np.uint64(16)) | (data[byte + 3].astype(np.uint64) << np.uint64(8))
        look = ((four >> (np.uint64(8 + wide) - (at & 7).astype(np.uint64))) & np.uint64(mask)).astype(np.int64)
        out[: len(at), i] = c.symbol_at[look]
        at = at + c.length_at[look]
    return out.reshape(-1)[:n]


# ---- tokens


@cache
def _tokenizer(path: str, special: bool = False):
    """``special``: the strings of special tokens in a text are those tokens, as the library has it; else ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = not special
    return t


@cache
def _added(path: str) -> tuple[str, ...]:
    """The strings of the tokens that were added to the vocabulary; a text that holds one is left whole."""
    return tuple(x.content for x in _tokenizer(path).get_added_tokens_decoder().values())


@cache
def _lengths_of(path: str) -> np.ndarray:
    """Bytes of each id's piece; a byte-level vocabulary has one character a byte."""
    t = _tokenizer(path)
    out = np.zeros(t.get_vocab_size(with_added_tokens=True), np.int64)
    for piece, i in t.get_vocab(with_added_tokens=True).items():
        out[i] = len(piece)
    return out


_caches: dict[str, WordCache] = {}


def _bytes(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, z in ranges:
        out[a : z + 1] = True
    return out


#: ASCII bytes by what the tokenizer's own splitting makes of them.
_WHITE, _LETTER, _SIGN = _bytes((9, 13), (28, 32)), _bytes((65, 90), (97, 122)), _bytes((33, 47), (58, 64), (91, 96), (123, 126))
_BLACK = _bytes((33, 126))
_LEAD = 0xC3  # leads the letters À to ÿ, and × and ÷
_NOT_LETTERS = (0x97, 0xB7)


def _wide_white(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether white space beyond ASCII stands before each position."""
    p1, p2, p3 = data[at - 1], data[at - 2], data[at - 3]
    out = (p2 == 0xC2) & ((p1 == 0x85) | (p1 == 0xA0))
    out |= (p3 == 0xE2) & (p2 == 0x80) & ((p1 <= 0x8A) | (p1 == 0xA8) | (p1 == 0xA9) | (p1 == 0xAF)) & (p1 >= 0x80)
    out |= (p3 == 0xE2) & (p2 == 0x81) & (p1 == 0x9F)
    return out | (p3 == 0xE1) & (p2 == 0x9A) & (p1 == 0x80) | (p3 == 0xE3) & (p2 == 0x80) & (p1 == 0x80)


def _cuts(data: np.ndarray, offsets: np.ndarray, added: tuple[bytes, ...]) -> np.ndarray:
    """Where texts are cut: only where the tokenizer itself always begins a new piece.

    That is at a space after another character, at a sign after a letter, and after a line feed between two visible
    characters. A text with white space before a space or a space at its end, or with an added token, is left whole.
    """
    n = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.int64)
    cut = np.zeros(len(data) + 1, bool)
    after, before = data[1:], data[:-1]
    cut[1:-1] = _SIGN[after] & _LETTER[before]
    latin = np.flatnonzero(before == _LEAD) + 1
    latin = latin[latin + 1 < len(data)]
    cut[latin + 1] |= _SIGN[data[latin + 1]] & (data[latin] != _NOT_LETTERS[0]) & (data[latin] != _NOT_LETTERS[1])
    feeds = np.flatnonzero(data == 10)
    feeds = feeds[(feeds > 0) & (feeds + 1 < len(data))]
    cut[feeds + 1] |= _BLACK[data[feeds - 1]] & (_BLACK[data[feeds + 1]] | (data[feeds + 1] == _LEAD))
    spaces = np.flatnonzero(data == 32)
    cut[spaces] = True
    starts = np.zeros(len(data) + 1, bool)
    starts[offsets] = True
    cut[starts] = False
    inner = spaces[~starts[spaces]]
    bad = inner[_WHITE[data[inner - 1]] | _wide_white(data, inner)]
    whole = np.zeros(n, bool)
    whole[np.searchsorted(offsets, bad, "right") - 1] = True
    whole |= (offsets[1:] > offsets[:-1]) & (data[offsets[1:] - 1] == 32)
    blob = data.tobytes() if added else b""
    for x in added:
        at = blob.find(x)
        while at >= 0:
            whole[np.searchsorted(offsets, at, "right") - 1] = True
            at = blob.find(x, at + 1)
    for i in np.flatnonzero(whole):
        cut[offsets[i] : offsets[i + 1]] = False
    return np.flatnonzero(cut)


def _learn(path: str, units: list[bytes], kind: type, special: bool) -> list[bytes]:
    """Ids of the units. Those that begin with a space, hold no other and end visibly go many in one string, cut where its spaces are."""
    t, width = _tokenizer(path, special), _lengths_of(path)
    spaced = [len(u) > 1 and u[0] == 32 and u.rfind(b" ") == 0 and (33 <= u[-1] < 127 or not u.decode()[-1].isspace()) for u in units]
    words, others = list(compress(units, spaced)), [u.decode() for u, s in zip(units, spaced) if not s]
    out: list[bytes] = []
    for i in range(0, len(words), 1 << 14):
        joined = [b"".join(words[j : j + 256]) for j in range(i, min(len(words), i + (1 << 14)), 256)]
        for run, e in zip(joined, t.encode_batch_fast([x.decode() for x in joined], add_special_tokens=False)):
            ids = np.array(e.ids, np.int64)
            begins = np.flatnonzero(np.frombuffer(run, np.uint8) == 32)
            before = np.cumsum(width[ids]) - width[ids]
            cuts = (np.append(np.searchsorted(before, begins), len(ids)) * np.dtype(kind).itemsize).tolist()
            packed = ids.astype(kind).tobytes()
            out += [packed[a:z] for a, z in zip(cuts, cuts[1:])]
    own = (np.array(e.ids, kind).tobytes() for i in range(0, len(others), 1 << 10) for e in t.encode_batch_fast(others[i : i + (1 << 10)], add_special_tokens=False))
    learnt = iter(out)
    return [next(learnt if s else own) for s in spaced]


def encode_texts(text: pa.Array, path: str, end_id: int, kind: type, special: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of the texts: all ids, with ``end_id`` after each text, as integers of ``kind``; the number of ids of each text."""
    cache = _caches.setdefault(f"{path}{kind}{special}", WordCache())
    end = np.array([end_id], kind).tobytes()
    added = tuple(x.encode() for x in _added(path))
    for data, offsets in runs(text):
        yield gather(data, offsets, _cuts(data, offsets, added), lambda units: cache.encode(units, lambda new: _learn(path, new, kind, special)), end, kind)


def tokenize(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, special: bool = True) -> DataFrame:
    """doc_id and ids (packed integers) of each row; null texts are empty."""
    kind = _kind(tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = np.dtype(kind).itemsize
        for b in batches:
            done = 0
            for ids, counts in encode_texts(b.column("text"), tokenizer_path, end_id, kind, special):
                ends = np.cumsum(np.concatenate([[0], counts])) * width
                packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(done, len(counts)), packed.cast(pa.binary())], ["doc_id", "ids"])
                done += len(counts)

    return text_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary")


def _kind(tokenizer_path: str) -> type:
    return np.uint16 if len(_lengths_of(tokenizer_path)) <= 1 << 16 else np.uint32


def count_ids(tokens: DataFrame, n_ids: int, kind: type) -> np.ndarray:
    """How often each id occurs; n_ids numbers at most come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_ids, np.int64)
        for b in batches:
            total += np.bincount(np.frombuffer(b"".join(b.column("ids").to_pylist()), kind), minlength=n_ids)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    out = np.zeros(n_ids, np.int64)
    for i, n in tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n")).collect():
        out[i] = n
    return out


# ---- files


@dataclass
class PartFile(InputPartition):
    path: str
    start: int


@dataclass
class Written(WriterCommitMessage):
    partition: int
    names: list[tuple[str, int, int]]


def pack_part(doc_ids: list[int | None], counts: list[int], ids: np.ndarray, c: Codes) -> bytes:
    bits, offsets, n_bits = encode_bits(ids, c)
    head = struct.pack("<5Q", MAGIC, len(doc_ids), len(ids), n_bits, BLOCK_IDS)
    known = np.array([x or 0 for x in doc_ids], "<i8").tobytes() + np.array([x is None for x in doc_ids], np.uint8).tobytes()
    return head + known + np.array(counts, "<u4").tobytes() + offsets.astype("<u8").tobytes() + bits.tobytes()


def unpack_part(data: bytes, c: Codes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, null marks, ids of each row, all ids."""
    magic, rows, n, _, block = struct.unpack_from("<5Q", data)
    if magic != MAGIC:
        raise ValueError("not a token file")
    at = 40
    doc_ids, at = np.frombuffer(data, "<i8", rows, at), at + 8 * rows
    nulls, at = np.frombuffer(data, np.uint8, rows, at), at + rows
    counts, at = np.frombuffer(data, "<u4", rows, at), at + 4 * rows
    n_blocks = -(-n // block)
    offsets, at = np.frombuffer(data, "<u8", n_blocks, at), at + 8 * n_blocks
    return doc_ids, nulls, counts, decode_bits(np.frombuffer(data, np.uint8, offset=at), offsets, n, block, c)


@cache
def read_codes(path: str) -> Codes:
    return Codes.of(np.frombuffer(files.read_bytes(f"{path}/codes.bin"), np.uint8))


class TokenWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.kind = options["path"], np.dtype(options["kind"])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        codes, task = read_codes(self.path), TaskContext.get().partitionId()
        names: list[tuple[str, int, int]] = []
        doc_ids: list[int | None] = []
        counts: list[int] = []
        held: list[bytes] = []
        n = 0

        def flush() -> None:
            nonlocal n
            if doc_ids:
                name = files.part_name(task, len(names), ".ids")
                files.write_bytes(f"{self.path}/{name}", pack_part(doc_ids, counts, np.frombuffer(b"".join(held), self.kind), codes))
                names.append((name, len(doc_ids), n))
            doc_ids.clear()
            counts.clear()
            held.clear()
            n = 0

        for b in iterator:
            for doc_id, ids in zip(b.column(b.schema.get_field_index("doc_id")).to_pylist(), b.column(b.schema.get_field_index("ids"))):
                held.append(ids.as_py())
                doc_ids.append(doc_id)
                counts.append(len(held[-1]) // self.kind.itemsize)
                n += counts[-1]
                if n >= PART_IDS:
                    flush()
        flush()
        return Written(task, names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        parts = [x for m in sorted((m for m in messages if m), key=lambda m: m.partition) for x in m.names]
        files.write_manifest(self.path, [{"name": name, "rows": rows, "ids": ids} for name, rows, ids in parts])


class TokenReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.digest = options["path"], options.get("ids", "full") == "crc32"

    def partitions(self) -> list[InputPartition]:
        out, start = [], 0
        for x in files.read_manifest(self.path):
            out.append(PartFile(f"{self.path}/{x['name']}", start))
            start += x["ids"]
        return out

    def read(self, partition: InputPartition | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a folder without parts
            return
        doc_ids, nulls, counts, ids = unpack_part(files.read_bytes(partition.path), read_codes(self.path))
        ends = np.cumsum(counts.astype(np.int64))
        begins = ends - counts
        raw = memoryview(ids.astype("<u4").tobytes())
        crcs = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(begins.tolist(), ends.tolist())]
        columns: list[Any] = [pa.array(doc_ids, mask=nulls.astype(bool)), pa.array(begins + partition.start), pa.array(counts.astype(np.int64)), pa.array(crcs, pa.int64())]
        for i in range(0, len(crcs), 1000):
            if self.digest:
                lists = pa.nulls(len(crcs[i : i + 1000]), pa.list_(pa.int32()))
            else:
                cuts = np.append(begins[i : i + 1000], ends[i : i + 1000][-1])
                lists = pa.ListArray.from_arrays(pa.array((cuts - cuts[0]).astype(np.int32)), pa.array(ids[cuts[0] : cuts[-1]].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*(x.slice(i, 1000) for x in columns), lists], ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])


class TokenSource(DataSource):
    """``spark.read.format("token_ids")``; option ``ids`` is ``full`` or, for null lists, ``crc32``."""

    @classmethod
    def name(cls) -> str:
        return "token_ids"

    def schema(self) -> str:
        return "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<int>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return TokenReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return TokenWriter(dict(self.options))


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, special: bool = True) -> None:
    """Encode ``docs`` (doc_id, text) and write the ids to the folder ``path`` in ascending doc_id order, null first.

    Two passes: ids are written aside once, counted over all documents for the codes, then sorted by range and coded.
    Rows of one doc_id keep no order among themselves but that of their ids. The strings of special tokens
    in a text become those tokens' ids, as the library has it; without ``special`` they are ordinary text.
    """
    spark = docs.sparkSession
    spark.dataSource.register(TokenSource)
    kind = _kind(tokenizer_path)
    tokens = stage(tokenize(docs, tokenizer_path, end_id, special), "tokens", compression="zstd")
    counts = count_ids(tokens, len(_lengths_of(tokenizer_path)), kind)
    limit = max(SHORTEST_LIMIT, int(np.count_nonzero(counts) - 1).bit_length() if counts.any() else 1)
    files.write_bytes(f"{path}/codes.bin", code_lengths(counts, limit).tobytes())
    ordered = tokens.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    ordered.write.format("token_ids").option("kind", np.dtype(kind).str).mode("append").save(path)


def read_token_files(spark: SparkSession, path: str, ids: str = "full") -> DataFrame:
    spark.dataSource.register(TokenSource)
    return spark.read.format("token_ids").option("ids", ids).load(path)


def token_digest(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Write token files of ``docs`` and read them back: doc_id, start, n_tokens, ids_crc32, a row for each row.

    Nulls and ties: a null text is empty and has the end id alone; null doc_ids come first; repeated ids are
    neighbours, in the order of their ids as bytes. Strings of special tokens get those tokens' ids, as the library gives
    them by default. An empty table gives an empty result. Only the two columns named are read.
    """
    path = new_path(docs.sparkSession, "token-ids")
    write_token_files(docs, path, tokenizer_path, end_id)
    return read_token_files(docs.sparkSession, path, ids="crc32").select("doc_id", "start", "n_tokens", "ids_crc32")
