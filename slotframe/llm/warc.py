"""WARC archives as a Python data source, and the records that a table of pages becomes.

Each record is a gzip member of its own whose header's ``sl`` extra field holds the member's compressed and
uncompressed length, so a reader steps over a record without inflating it. Headers are inflated first; the payload
only if the record passes the predicates and payloads are asked for.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from base64 import b32encode
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from slotframe.llm import files
from slotframe.llm.common import new_path, stage

SCHEMA = "record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"
#: A task begins a new file beyond this size, so that no later task reads much more.
ROLL_BYTES = 64 << 20
HEAD_BYTES = 4096
BATCH_BYTES = 8 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return b32encode(hashlib.sha1(payload).digest()).decode()


def _line(name: str, value: Any) -> str:
    return "" if value is None else f"{name}: {str(value).replace('\r', '%0D').replace('\n', '%0A')}\r\n"


def encode_record(record_type: str, record_id: str, uri: str | None, refers_to: str | None, payload_digest: str, payload: bytes) -> bytes:
    """A response has the payload after its HTTP header; a revisit has the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http + payload if record_type == "response" else http
    head = f"WARC/1.1\r\nWARC-Type: {record_type}\r\n" + _line("WARC-Record-ID", f"<{record_id}>") + f"WARC-Date: {DATE}\r\n" + _line("WARC-Target-URI", uri)
    if record_type == "revisit":
        head += f"WARC-Profile: {PROFILE}\r\n" + _line("WARC-Refers-To", f"<{refers_to}>")
    head += f"WARC-Payload-Digest: sha1:{payload_digest}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 1) -> bytes:
    deflater = zlib.compressobj(level, zlib.DEFLATED, -zlib.MAX_WBITS)
    packed = deflater.compress(data) + deflater.flush()
    head = struct.pack("<BBBBIBB", 0x1F, 0x8B, 8, 4, 0, 0, 255)
    whole = len(head) + 14 + len(packed) + 8
    extra = struct.pack("<H2sHII", 12, b"sl", 8, whole, len(data) & 0xFFFFFFFF)
    return head + extra + packed + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


@dataclass
class Predicates:
    """Header name (lower case) to the values that pass; records lacking the header fail."""

    wanted: dict[str, set[str]] = field(default_factory=dict)

    def add(self, name: str, values: set[str]) -> None:
        self.wanted[name] = self.wanted[name] & values if name in self.wanted else values

    def passes(self, headers: dict[str, str]) -> bool:
        return all(headers.get(k) in v for k, v in self.wanted.items())


def parse_headers(block: bytes) -> dict[str, str]:
    pairs = (x.split(":", 1) for x in block.decode("utf-8", "replace").split("\r\n")[1:] if ":" in x)
    return {k.strip().lower(): v.strip() for k, v in pairs}


def read_records(stream: Any, predicates: Predicates, payloads: bool) -> Iterator[dict[str, Any]]:
    """The records of one file that pass. With ``payloads``, digest and length come from the payload itself."""
    while fixed := stream.read(24):
        if len(fixed) < 24 or fixed[:4] != b"\x1f\x8b\x08\x04" or fixed[12:14] != b"sl":
            raise ValueError("not a record member with skip lengths")
        (whole,) = struct.unpack_from("<I", fixed, 16)
        packed = stream.read(whole - 24)
        inflater = zlib.decompressobj(-zlib.MAX_WBITS)
        data = inflater.decompress(packed, HEAD_BYTES)
        while (end := data.find(b"\r\n\r\n")) < 0:
            more = inflater.decompress(inflater.unconsumed_tail, HEAD_BYTES)
            if not more:
                raise ValueError("a record's header doesn't end")
            data += more
        headers = parse_headers(data[:end])
        if not predicates.passes(headers):
            continue
        length, revisit = int(headers["content-length"]), headers["warc-type"] == "revisit"
        if payloads or revisit:
            data += inflater.decompress(inflater.unconsumed_tail) if inflater.unconsumed_tail else b""
            data += inflater.flush()
        else:
            while data.find(b"\r\n\r\n", end + 4) < 0:
                data += inflater.decompress(inflater.unconsumed_tail, HEAD_BYTES)
        cut = data.index(b"\r\n\r\n", end + 4) + 4
        out = {"record_type": headers["warc-type"], "record_id": headers["warc-record-id"][1:-1], "target_uri": headers.get("warc-target-uri")}
        out |= {"refers_to": headers["warc-refers-to"][1:-1] if revisit else None, "payload_digest": headers["warc-payload-digest"].removeprefix("sha1:")}
        out |= {"payload_bytes": int(parse_headers(data[end + 4 : cut])["content-length"]), "payload": None}
        if payloads and not revisit:
            payload = data[cut : end + 4 + length]
            out |= {"payload_digest": digest(payload), "payload_bytes": len(payload), "payload": payload}
        yield out


@dataclass
class FilePartition(InputPartition):
    path: str


@dataclass
class Written(WriterCommitMessage):
    names: list[tuple[str, int, int]]


class WarcReader(DataSourceReader):
    """Options: ``payload`` is ``none``, ``check`` (read it for digest and length, return none) or ``full``; ``types`` lists record types."""

    #: Columns whose predicates are tested on the headers.
    HEADERS = {"record_type": "warc-type", "target_uri": "warc-target-uri"}

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.payload, self.predicates = options["path"], options.get("payload", "none"), Predicates()
        if types := options.get("types"):
            self.predicates.add("warc-type", set(types.split(",")))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and (name := self.HEADERS.get(".".join(f.attribute))):
                self.predicates.add(name, {f.value} if isinstance(f, EqualTo) else set(f.value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [FilePartition(f"{self.path}/{x['name']}") for x in files.read_manifest(self.path)]

    def read(self, partition: InputPartition | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # an archive without files
            return
        schema = pa.schema([(n, t) for n, t in (("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()))])
        store, at = files.resolve(partition.path)
        rows: list[dict[str, Any]] = []
        held = 0
        with store.open_input_stream(at, compression=None, buffer_size=1 << 20) as f:
            for r in read_records(f, self.predicates, self.payload != "none"):
                if self.payload == "check":
                    r["payload"] = None
                rows.append(r)
                held += 200 + len(r["payload"] or b"")
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        task, names = TaskContext.get().partitionId(), []
        buffer, n = io.BytesIO(), 0

        def flush() -> None:
            nonlocal buffer, n
            if n:
                name = files.part_name(task, len(names), ".warc.gz")
                files.write_bytes(f"{self.path}/{name}", buffer.getbuffer())
                names.append((name, n, buffer.tell()))
            buffer, n = io.BytesIO(), 0

        for batch in iterator:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("record_type", "record_id", "target_uri", "refers_to", "payload_digest", "payload")]
            for i in range(batch.num_rows):
                kind, rid, uri, refers, sha, payload = (c[i].as_py() for c in columns)
                buffer.write(gzip_member(encode_record(kind, rid, uri, refers, sha, payload or b"")))
                n += 1
                if buffer.tell() >= ROLL_BYTES:
                    flush()
        flush()
        return Written(names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files.write_manifest(self.path, [{"name": name, "records": n, "bytes": size} for m in messages if m for name, n, size in m.names])


class WarcSource(DataSource):
    """``spark.read.format("warc")`` and ``df.write.format("warc")``, after ``spark.dataSource.register(WarcSource)``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(dict(self.options))


def records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """The WARC record of each row of ``pages`` (page_id, url, html), in the columns of ``SCHEMA``.

    Of equal payloads of at least ``least_bytes`` the row with the smallest page_id is the response. Digests decide
    which payloads are equal: SHA-1, length and a second hash. Only payloads that occur more than once are kept
    aside; where that table is small, as its written size tells, pages are not shuffled.

    Nulls and ties: a null html is an empty payload; a null url leaves out the target; a null page_id makes a record
    id without a number, loses to any other and, among null ids only, makes each row a response. Repeated rows of
    the smallest page_id are each a response. An empty table gives no records.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    keys = [F.sha1(payload).alias("h"), F.octet_length(payload).cast("long").alias("n"), F.xxhash64(payload).alias("x")]
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("target_uri"), payload.alias("payload"), *keys)
    groups = base.filter(F.col("n") >= least_bytes).groupBy("h", "n", "x").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("rows"))
    twice = stage(groups.filter("rows > 1").drop("rows"), "warc-repeats")
    met = base.join(twice, ["h", "n", "x"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    hex_parts = [F.lpad(F.conv(F.substring("h", 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    base32 = F.translate(F.concat(*hex_parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    page = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    return met.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        page("page_id").alias("record_id"),
        "target_uri",
        F.when(revisit, page("first")).alias("refers_to"),
        base32.alias("payload_digest"),
        F.col("n").alias("payload_bytes"),
        F.col("payload").cast("binary").alias("payload"),
    )


def write_warc(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    pages.sparkSession.dataSource.register(WarcSource)
    records(pages, least_bytes).write.format("warc").mode("append").save(path)


def read_warc(spark: SparkSession, path: str, payload: str = "full", types: str | None = None) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # a reader that takes filters needs it
    spark.dataSource.register(WarcSource)
    reader = spark.read.format("warc").option("payload", payload)
    return (reader.option("types", types) if types else reader).load(path)


def page_records(pages: DataFrame) -> DataFrame:
    """Archive ``pages`` and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_warc(pages, path)
    number = lambda c: F.when(F.length(c) > 9, F.substring(c, 10, 20).cast("long"))  # noqa: E731  after urn:page:
    back = read_warc(spark, path, payload="check")
    return back.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(encode(coalesce(html, ''))) AS h FROM pages),
m AS (SELECT *, min(page_id) OVER (PARTITION BY b) AS first FROM p)
SELECT page_id, octet_length(b) AS payload_bytes,
       list_aggregate(list_transform(generate_series(0, 31), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INTEGER, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM m
"""
