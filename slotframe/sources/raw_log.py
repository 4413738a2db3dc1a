"""Logs as bytes: records packed one after another in segments, and parsed back."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotframe.functions import packed

SLOTS = "slot_lower long, slot_upper long, header_size long, kind_tag int, payload binary"
#: Records of consecutive sequence numbers that make one segment.
SEGMENT = 1000


def pack(framed: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """base, data: framed records (kind_tag, body, body_size) as segments of bytes, each beginning with a whole record.

    A record is the varint of its body's length, a tag byte and the payload.
    """
    record = F.concat(packed.varint_hex(F.col("body_size")), packed.int_hex(F.col("kind_tag").cast("long"), 1), F.hex(F.col("body").cast("binary")))
    rows = framed.select(F.floor(F.col("seq") / segment).alias("segment"), F.struct("slot_lower", record.alias("hex")).alias("r"))
    sorted_hex = F.transform(F.array_sort(F.collect_list("r")), lambda r: r["hex"])
    return rows.groupBy("segment").agg(F.min("r.slot_lower").alias("base"), F.unhex(F.array_join(sorted_hex, "")).alias("data")).select("base", "data")


def parse_segment(data: bytes, base: int) -> Iterator[tuple[int, int, int, int | None, bytes]]:
    """Records of a segment: lower, upper, head bytes, tag, payload. Stops at a record that is cut short.

    The head's size is what was written, which may be more than the least; an empty record has no tag and is passed
    over, and takes up its place.
    """
    at, end = 0, len(data)
    while at < end:
        size = shift = 0
        head = at
        while head < end and data[head] & 128:
            size |= (data[head] & 127) << shift
            shift += 7
            head += 1
        if head == end:
            return
        size |= data[head] << shift
        head += 1
        if head + size > end:
            return
        if size:
            yield base + at, base + head + size, head - at, data[head], data[head + 1 : head + size]
        at = head + size


def parse(segments: DataFrame) -> DataFrame:
    """slot_lower, slot_upper, header_size, kind_tag, payload of every whole record of the segments (base, data)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for base, data in zip(b["base"], b["data"]):
                yield pd.DataFrame(list(parse_segment(bytes(data), int(base))), columns=["slot_lower", "slot_upper", "header_size", "kind_tag", "payload"])

    return segments.select("base", "data").mapInPandas(run, SLOTS)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """base, data of the files of a folder, each named by its base offset in decimal; whole files are read by Spark."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.regexp_extract("path", r"(\d+)[^/]*$", 1).cast("long").alias("base"), F.col("content").alias("data"))
