"""Which records changed: a content hash by key, as a table and as a stream with state that goes when its time is over.

A row (key, ts, id, content) is a change if, in the order of (ts, id), its hash is not that of the key's row before, or if that row is more than ``keep`` earlier (its
state is gone by then). A changed record is pending: whatever is derived from it has to be made anew. A row that comes again, with the same key, ts and id, counts once. As a
stream, rows wait until the watermark has passed them, so that they are compared in order whichever way they arrive; rows behind the watermark are dropped. A key's state ends
``keep`` after its last row by a timer on the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that keyed state with timers needs.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
OUT = "key string, ts timestamp, id bigint, sha256 string, pending boolean"


def hashed(rows: DataFrame, key: str, ts: str, row_id: str, content: tuple[str, ...]) -> DataFrame:
    """key, ts, id, sha256 of rows; parts of the content are kept apart, and null is not the empty text."""
    parts = [F.coalesce(F.concat(F.lit("="), F.base64(F.col(c).cast("string").cast("binary"))), F.lit("-")) for c in content]
    return rows.select(F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("ts"), F.col(row_id).cast("long").alias("id"), F.sha2(F.concat_ws(",", *parts), 256).alias("sha256"))


def content_changes(rows: DataFrame, key: str, ts: str, row_id: str, content: tuple[str, ...], keep_seconds: int) -> DataFrame:
    """The changes of a table."""
    own = hashed(rows, key, ts, row_id, content).where("key IS NOT NULL AND ts IS NOT NULL").dropDuplicates(["key", "ts", "id"])
    w = Window.partitionBy("key").orderBy("ts", "id")
    before, when = F.lag("sha256").over(w), F.lag("ts").over(w)
    late = F.unix_micros("ts") - F.unix_micros(when) > keep_seconds * 1_000_000
    return own.withColumn("new", before.isNull() | (before != F.col("sha256")) | late).where("new").select("key", "ts", "id", "sha256", F.lit(True).alias("pending"))


class Changes(StatefulProcessor):
    """State of a key: rows that wait for the watermark, and the last row that it passed."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us bigint, id bigint, sha256 string")
        self.last = handle.getValueState("last", "us bigint, id bigint, sha256 string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = self.last.get() if self.last.exists() else None
        for frame in rows:
            us = frame["ts"].astype("datetime64[us]").astype("int64")
            fresh = [(int(u), int(i), s) for u, i, s in zip(us, frame["id"], frame["sha256"]) if seen is None or (u, i) > (seen[0], seen[1])]
            if fresh:
                self.waiting.appendList(fresh)
                for ms in {-(-u // 1_000) for u, _, _ in fresh}:
                    self.handle.registerTimer(ms)
        yield pd.DataFrame(columns=["key", "ts", "id", "sha256", "pending"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held = sorted({tuple(r) for r in self.waiting.get()})
        due, rest = [r for r in held if r[0] <= now * 1_000], [r for r in held if r[0] > now * 1_000]
        last = tuple(self.last.get()) if self.last.exists() else None
        out = []
        for us, i, sha in due:
            if last is None or sha != last[2] or us - last[0] > self.keep_ms * 1_000:
                out.append((key[0], pd.Timestamp(us, unit="us"), i, sha, True))
            last = (us, i, sha)
        if due:
            self.waiting.put(rest) if rest else self.waiting.clear()
            self.last.update(last)
            self.handle.registerTimer(-(-last[0] // 1_000) + self.keep_ms + 1)
        elif last is not None and now > last[0] // 1_000 + self.keep_ms:
            self.last.clear()
        yield pd.DataFrame(out, columns=["key", "ts", "id", "sha256", "pending"])

    def close(self) -> None:
        pass


def content_changes_stream(rows: DataFrame, key: str, ts: str, row_id: str, content: tuple[str, ...], keep_seconds: int, late: str) -> DataFrame:
    """The changes of a stream, each once the watermark (``late`` behind the newest row) has passed it."""
    own = hashed(rows, key, ts, row_id, content).where("key IS NOT NULL").withWatermark("ts", late)
    return own.groupBy("key").transformWithStateInPandas(Changes(keep_seconds * 1_000), OUT, "Append", "eventTime")


def without_replays(rows: DataFrame, ts: str, row_id: str, late: str) -> DataFrame:
    """A stream in which each id comes once, as long as it comes again within ``late``."""
    return rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark([row_id])
