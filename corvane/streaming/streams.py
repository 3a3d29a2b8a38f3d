"""Streams: files that arrive, chat histories as state, windows over events, and the event log."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import events as E
from ..operators.index import Snapshots, upsert

BINARY = "path string, modificationTime timestamp, length long, content binary"
CHAT = "user_id string, chat_id string, position int, role string, content string"


def arriving_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    return spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)


def upsert_stream(rows: DataFrame, store: Snapshots, key: str, checkpoint: str, *order: str) -> StreamingQuery:
    """Each batch goes into a new snapshot. A batch that comes again after a failure changes nothing."""

    def batch(df: DataFrame, _: int) -> None:
        held = store.read()
        store.write(upsert(df.limit(0) if held is None else held, df, key, *order))

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class ChatHistory(StatefulProcessor):
    """The trimmed history of one (user_id, chat_id): repeated last messages are ignored, old ones fall out."""

    def __init__(self, most: int = 100, chars: int = 500_000) -> None:
        self.most, self.chars = most, chars

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.turns = handle.getListState("turns", "role string, content string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:
        held = [tuple(t) for t in self.turns.get()]
        for r in sorted((r for b in rows for r in b.itertuples(index=False)), key=lambda r: r.position):
            content = (r.content or "").strip()
            if content and r.role in ("system", "user", "assistant", "tool") and (not held or held[-1] != (r.role, content)):
                held.append((r.role, content))
        kept, left = [], self.chars
        for role, content in reversed(held[-self.most :]):
            if left <= 0:
                break
            kept.append((role, content[-left:]))
            left -= len(kept[-1][1])
        kept.reverse()
        self.turns.put(kept)
        yield pd.DataFrame([(*key, i, r, c) for i, (r, c) in enumerate(kept)], columns=["user_id", "chat_id", "position", "role", "content"])

    def close(self) -> None:
        pass


def chat_histories(messages: DataFrame, most: int = 100, chars: int = 500_000) -> DataFrame:
    """Histories after each batch, for the chats that it touched."""
    return messages.groupBy("user_id", "chat_id").transformWithStateInPandas(statefulProcessor=ChatHistory(most, chars), outputStructType=CHAT, outputMode="Update", timeMode="None")


def windowed(events: DataFrame, size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def event_log(events: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends what may be kept of stage events to JSON lines."""
    return E.persisted(events).writeStream.format("json").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
