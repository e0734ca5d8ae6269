"""Streams that keep state by key: statuses of an ingest that resumes (ST2) and presence with a time to live (ST6).

Both need the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``) and run from their checkpoint on.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Statuses between pending and an end, and the ends.
IN_FLIGHT, ENDS = ("processing", "analyzing", "parsing"), ("processed", "failed")
#: Fixed value: milliseconds for which a heartbeat holds.
PRESENT_MS = 8000

_STATUS = "content_id string, run long, status string, reason string"


def next_status(known: tuple[str, int] | None, event: str, run: int) -> list[tuple[str, str]]:
    """The statuses, each with its reason, that an event of a run gives to a document of known (status, run).

    A document in flight under an earlier run was stranded by it: it is pending again. A document seen anew is pending;
    one that is known is not taken twice, also if it failed.
    """
    out = []
    status, last = known or (None, run)
    if status in IN_FLIGHT and run > last:
        out.append((status := "pending", "stranded"))
    if event == "seen":
        return out + ([("pending", "new")] if status is None else [])
    if event in IN_FLIGHT or event in ENDS:
        out.append((event, "reported"))
    return out


class _Statuses(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "status string, run long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known, out = self.known.get() if self.known.exists() else None, []
        events = pd.concat(list(rows)).sort_values(["run", "seq"])
        for run, event in events[["run", "event"]].itertuples(index=False):
            for status, reason in next_status(known, event, int(run)):
                out.append((key[0], int(run), status, reason))
                known = status, int(run)
        if known is not None:
            self.known.update((known[0], int(known[1])))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _STATUS.split(", ")])

    def close(self) -> None:
        pass


def statuses(events: DataFrame) -> DataFrame:
    """What becomes of documents by the events (content_id, run, seq, event) of ingest runs: content_id, run, status, reason.

    A stream of appends, or, from a table, all of them. A run begins by reporting every file it finds as seen, so what an
    earlier run left in flight is pending again before anything is skipped.
    """
    _ = events.sparkSession.streams.active  # what keeps state in batches, too, begins with the manager of streams
    own = events.select("content_id", F.col("run").cast("long").alias("run"), F.col("seq").cast("long").alias("seq"), "event")
    return own.groupBy("content_id").transformWithStateInPandas(statefulProcessor=_Statuses(), outputStructType=_STATUS, outputMode="append", timeMode="none")


_PRESENCE = "chat_id string, user_id string, at_ms long, present boolean"


class _Presence(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "at_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, out = int(self.seen.get()[0]) if self.seen.exists() else None, []
        for at, typing in pd.concat(list(rows)).sort_values("at_ms")[["at_ms", "typing"]].itertuples(index=False):
            if last is not None and at >= last + PRESENT_MS:  # came back after it had aged out
                out.append((*key, last + PRESENT_MS, False))
                last = None
            if typing and last is None:
                out.append((*key, int(at), True))
            if not typing and last is not None:
                out.append((*key, int(at), False))
            last = max(int(at), last or 0) if typing else None
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if last is None:
            self.seen.clear()
        else:
            self.seen.update((last,))
            self.handle.registerTimer(last + PRESENT_MS)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _PRESENCE.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.seen.exists() and int(self.seen.get()[0]) + PRESENT_MS <= expiredTimerInfo.getExpiryTimeInMs():
            out.append((*key, int(self.seen.get()[0]) + PRESENT_MS, False))
            self.seen.clear()
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _PRESENCE.split(", ")])

    def close(self) -> None:
        pass


def presence_changes(heartbeats: DataFrame, late: str = "1 minute") -> DataFrame:
    """When users of a chat come and go: chat_id, user_id, at_ms, present, from heartbeats (chat_id, user_id, ts, typing).

    A heartbeat holds for eight seconds of event time; one that says so ends it at once. A timer tells of those who vanish,
    once the watermark has passed their end.
    """
    own = heartbeats.select(F.col("chat_id").cast("string").alias("chat_id"), F.col("user_id").cast("string").alias("user_id"), "ts", F.unix_millis("ts").alias("at_ms"), "typing").withWatermark("ts", late)
    return own.groupBy("chat_id", "user_id").transformWithStateInPandas(statefulProcessor=_Presence(), outputStructType=_PRESENCE, outputMode="append", timeMode="eventTime")


def present_at(changes: DataFrame, at_ms: int, chat_id: str, but: str) -> DataFrame:
    """user_id of those in a chat at a moment, the asker left out: the last change at or before it says so."""
    before = changes.filter((F.col("at_ms") <= at_ms) & (F.col("chat_id") == chat_id) & (F.col("user_id") != but))
    return before.groupBy("user_id").agg(F.max_by("present", F.struct("at_ms", ~F.col("present"))).alias("present")).filter("present").select("user_id")
