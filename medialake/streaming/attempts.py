"""Keyed state of streams: failed attempts of items, content that was seen, sessions of events."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTCOMES = "id long, attempts int, state string, at timestamp"


def keyed_state(spark: SparkSession) -> None:
    """Lets the session keep arbitrary state by key: on disk, with changes in the query's checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class Attempts(StatefulProcessor):
    """Counts an item's failures since its last success; parks it at the most that are allowed.

    A success clears the state, and so does a timer, if nothing is heard of the item for a while. A parked item stays
    parked, whatever comes.
    """

    def __init__(self, most: int, forget: timedelta | None):
        self.most, self.forget = most, int(forget.total_seconds() * 1000) if forget else None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.failures = handle.getValueState("failures", "attempts int, last long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        told = pd.concat(list(rows)).sort_values(["at", "ok"], kind="stable")  # one micro-batch's rows of the item
        attempts = self.failures.get()[0] if self.failures.exists() else 0
        was = attempts
        for ok in told["ok"]:
            if attempts < self.most:
                attempts = 0 if ok else attempts + 1
        at = told["at"].iloc[-1]
        if attempts:
            last = int(at.timestamp() * 1000)
            self.failures.update((attempts, last))
            if self.forget and attempts < self.most:
                self.handle.registerTimer(last + self.forget)
        elif was:
            self.failures.clear()
        state = "error" if attempts >= self.most else "retry" if attempts else "done"
        yield pd.DataFrame({"id": [key[0]], "attempts": [attempts], "state": [state], "at": [at]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """What was forgotten; timers of failures that others followed, or of parked items, do nothing."""
        attempts, last = self.failures.get() if self.failures.exists() else (0, 0)
        if 0 < attempts < self.most and last + self.forget <= expiredTimerInfo.getExpiryTimeInMs():
            self.failures.clear()
            yield pd.DataFrame({"id": [key[0]], "attempts": [0], "state": ["forgotten"], "at": [pd.Timestamp(last, unit="ms")]})

    def close(self) -> None:
        pass


def attempts(tries: DataFrame, most: int = 3, forget: timedelta | None = None, late: str = "1 hour") -> DataFrame:
    """After each micro-batch of tries (id, ok, at) the items it tells of, and whether they are retried, parked or done.

    With forget, failures that nothing follows for so long (of event time, behind the watermark) are forgotten.
    """
    keyed_state(tries.sparkSession)
    rows = tries.select("id", "ok", "at")
    mode = "EventTime" if forget else "None"
    rows = rows.withWatermark("at", late) if forget else rows
    return rows.groupBy("id").transformWithStateInPandas(Attempts(most, forget), outputStructType=OUTCOMES, outputMode="Update", timeMode=mode)


class Unseen(StatefulProcessor):
    """Lets the first row of each content through; one that is to be tried again doesn't count as seen."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.seen.update((True,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        told = pd.concat(list(rows)).sort_values(["staged_at", "id"], kind="stable")
        again = told["lifecycle"] == "retry"
        new = told[~again].head(0 if self.seen.exists() else 1)
        if len(new):
            self.seen.update((True,))
        out = pd.concat([new, told[again] if not self.seen.exists() else told.head(0)])
        if len(out):
            yield out.drop(columns="content")

    def close(self) -> None:
        pass


def unseen(gated: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Rows of a gated stream without those whose content (sha256) an earlier row had: the state holds hashes, no files.

    Rows without a hash are contents of their own. known (sha256) is what a library had before the stream began.
    """
    keyed_state(gated.sparkSession)
    content = F.coalesce("sha256", F.concat(F.lit("row "), F.col("id"), F.lit(" "), F.coalesce("path", F.lit(""))))
    initial = known.select(F.col("sha256").alias("content")).distinct().groupBy("content") if known is not None else None
    return gated.withColumn("content", content).groupBy("content").transformWithStateInPandas(
        Unseen(), outputStructType=gated.schema, outputMode="Append", timeMode="None", initialState=initial
    )


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """Sessions of each user's events (event_id, user_id, ts): a pause of gap or more begins one.

    As a stream, repeated events within the watermark count once, and a session comes out when the watermark has passed
    it; later rows are dropped, and counted in the query's progress (see dropped()).
    """
    if events.isStreaming:
        events = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    else:
        events = events.dropDuplicates(["event_id"])
    found = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return found.select("user_id", "first", "last", "n")


def dropped(query) -> int:
    """Rows that a finished streaming query has left out because they came too late."""
    return sum(int(o["numRowsDroppedByWatermark"]) for p in query.recentProgress for o in p["stateOperators"])
