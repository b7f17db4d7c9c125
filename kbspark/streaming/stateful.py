"""Streams with keyed state and timers: failure limiter (J3) and liveness alerts.

Both need Spark's RocksDB state store (``spark.sql.streaming.stateStore.providerClass``, see :func:`use_rocksdb`).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

LIMITED = "key long, event_id long, t long, failures int, blocked boolean, wait int"
ALERT = "key long, last long, alert string"


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state with timers lives in RocksDB; the setting counts for streams started after it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Limiter(StatefulProcessor):
    """State of a key: the times of its failures in the trailing window, and when its block ends."""

    def __init__(self, limit: int, seconds: int):
        self.limit, self.seconds = limit, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getListState("failures", "t long")
        self.ends = handle.getValueState("ends", "t long")

    def _end(self, times: list[int], t: int) -> int | None:
        """When ``times``, those within the window at ``t``, are fewer than the limit again; None where they are."""
        return max(t + 1, times[-self.limit] + self.seconds) if len(times) >= self.limit else None

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = sorted(r[0] for r in self.times.get()) if self.times.exists() else []
        was = self.ends.get()[0] if self.ends.exists() else None
        out, end = [], was
        for r in pd.concat(list(rows)).sort_values(["t", "event_id"]).itertuples():
            times = [x for x in times if x > r.t - self.seconds]
            if r.kind == "success":
                times = []
            elif r.kind == "failure":
                times = sorted([*times, r.t])
            end = self._end(times, r.t)
            out.append((key[0], r.event_id, r.t, len(times), end is not None, None if end is None else end - r.t))
        if times:
            self.times.put([(t,) for t in times])
        else:
            self.times.clear()
        if end != was:
            if was is not None:
                self.handle.deleteTimer(was * 1000)
                self.ends.clear()
            if end is not None:
                self.handle.registerTimer(end * 1000)
                self.ends.update((end,))
        yield _frame(out, LIMITED)

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        t = expiredTimerInfo.getExpiryTimeInMs() // 1000
        times = [r[0] for r in self.times.get() if r[0] > t - self.seconds] if self.times.exists() else []
        self.ends.clear()
        if times:
            self.times.put([(x,) for x in times])
        else:
            self.times.clear()
        yield _frame([(key[0], None, t, len(times), False, None)], LIMITED)

    def close(self) -> None:
        pass


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    kinds = {"long": "Int64", "int": "Int32", "boolean": "boolean", "string": "object"}
    fields = [f.split() for f in schema.split(", ")]
    return pd.DataFrame(rows, columns=[f for f, _ in fields]).astype({f: kinds[k] for f, k in fields})


def failure_limiter_stream(events: DataFrame, limit: int, seconds: int, late: str = "0 seconds") -> DataFrame:
    """The decisions of ``failure_limiter`` for a stream (key, event_id, ts, kind), plus t, their second, and a row without
    event_id when a key's block ends by time.

    The release is an event-time timer at the end of the block, so it comes with the watermark, whether or not the key is heard of
    again; a later failure moves it, a success cancels it.  Events of a micro-batch are sorted first.
    """
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    rows = rows.select("key", "event_id", "ts", F.unix_timestamp("ts").alias("t"), "kind")
    return rows.groupBy("key").transformWithStateInPandas(
        statefulProcessor=_Limiter(limit, seconds), outputStructType=LIMITED, outputMode="Append", timeMode="EventTime"
    )


class _Liveness(StatefulProcessor):
    """State of a worker: its latest heartbeat, whether it was reported, and its timer."""

    def __init__(self, stale_seconds: float):
        self.wait = int(stale_seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "last long, stale boolean, timer long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, stale, timer = self.state.get() if self.state.exists() else (None, False, None)
        last = max([int(b["t"].max()) for b in rows] + ([] if last is None else [last]))
        if timer is not None and not stale:
            self.handle.deleteTimer(timer)
        timer = timerValues.getCurrentProcessingTimeInMs() + self.wait
        self.handle.registerTimer(timer)
        self.state.update((last, False, timer))
        yield _frame([(key[0], last, "back")] if stale else [], ALERT)

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.state.get()[0]
        self.state.update((last, True, 0))
        yield _frame([(key[0], last, "stale")], ALERT)

    def close(self) -> None:
        pass


def liveness_alerts(heartbeats: DataFrame, stale_seconds: float) -> DataFrame:
    """A stream of (key, last, alert): ``stale`` once when nothing came from a worker for ``stale_seconds``, ``back`` with its next heartbeat.

    Timers run on processing time, so a silent worker is reported without any further input.
    """
    rows = heartbeats.select("key", F.unix_timestamp("ts").alias("t"))
    return rows.groupBy("key").transformWithStateInPandas(
        statefulProcessor=_Liveness(stale_seconds), outputStructType=ALERT, outputMode="Append", timeMode="ProcessingTime"
    )
