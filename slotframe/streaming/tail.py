"""Streaming forms: the tail scan of a log, key-value replay and exactly-once updates with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from slotframe.operators.staging import shared_path
from slotframe.schemas import EVENTS
from slotframe.sources.adapters import log_of


def event_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Events as they arrive in a folder; a path that is one file is that folder with the one name allowed."""
    reader = spark.readStream.schema(EVENTS)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        path, _, name = path.rpartition("/")
        reader = reader.option("pathGlobFilter", name)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def tail_scan(spark: SparkSession, path: str) -> DataFrame:
    """The log's records, in the same columns as the batch scan; framing needs all earlier bytes and is left to the batch side."""
    return log_of(event_stream(spark, path))


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now, written to the shared folder with a checkpoint, and read the rows."""
    spark = stream.sparkSession
    home = shared_path(spark, "stream")
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{home}/rows").option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{home}/rows")


def exactly_once(updates: DataFrame) -> DataFrame:
    """Stateful gate on updates (arrival, client, user_slot): the rows above all that their client sent before.

    The state is one number a client, so it follows the number of clients, not the length of the log.
    """

    def gate(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("arrival")
        last = state.get[0] if state.exists else -1
        before = rows["user_slot"].cummax().shift(fill_value=-1).clip(lower=last)
        keep = rows["user_slot"] > before
        state.update((int(max(last, rows["user_slot"].max())),))
        yield rows[keep][["arrival", "client", "user_slot"]]

    return updates.groupBy("client").applyInPandasWithState(gate, "arrival long, client long, user_slot long", "last long", "append", GroupStateTimeout.NoTimeout)


def kv_changes(events: DataFrame) -> DataFrame:
    """Stateful replay of (seq, op, key, value): after each batch the latest event of each key it touched."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("seq")
        new = rows.iloc[-1]
        if not state.exists or state.get[0] < int(new["seq"]):
            state.update((int(new["seq"]),))
            yield pd.DataFrame({"seq": [int(new["seq"])], "op": [new["op"]], "key": [int(key[0])], "value": [new["value"]]})

    return events.groupBy("key").applyInPandasWithState(fold, "seq long, op string, key long, value string", "last long", "append", GroupStateTimeout.NoTimeout)
