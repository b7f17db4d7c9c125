"""Usage limits, failure limiter, sessions, liveness and ingest: batch forms over an event table and streams (J)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kbspark.functions.text import content_hash
from kbspark.operators.chunking import recursive_chunks
from kbspark.sources.shared import exists

DECISION = "key long, event_id long, allowed boolean, reason string, retry_after int"
STATE = "minute_start double, minute_count int, day long, day_count int"


class UsageCounter:
    """Counters of one key: a 60 s window from its first request, and a UTC day.  Refused requests count in neither."""

    def __init__(self, rpm: int, daily: int, state: tuple[float, int, int, int] = (-1.0, 0, -1, 0)):
        self.rpm, self.daily = rpm, daily
        self.start, self.count, self.day, self.day_count = state

    def state(self) -> tuple[float, int, int, int]:
        return self.start, self.count, self.day, self.day_count

    def request(self, ts: float) -> tuple[bool, str | None, int | None]:
        day = int(ts // 86400)
        fresh = self.start < 0 or ts - self.start >= 60
        start, count = (ts, 0) if fresh else (self.start, self.count)
        day_count = self.day_count if day == self.day else 0
        if count >= self.rpm:
            return False, "minute", max(1, int(60 - (ts - start)))
        if day_count >= self.daily:
            return False, "day", max(1, int((day + 1) * 86400 - ts))
        self.start, self.count, self.day, self.day_count = start, count + 1, day, day_count + 1
        return True, None, None


def usage_limits(events: DataFrame, rpm: int, daily: int) -> DataFrame:
    """Decisions over a table (key, event_id, ts), in order of ts and event_id.

    A key's rows arrive sorted and in batches; only its counters are held, so a hot key needs no more memory than another.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, counter = None, None
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                if counter is None or r.key != key:
                    key, counter = r.key, UsageCounter(rpm, daily)
                out.append((r.key, r.event_id, *counter.request(r.t)))
            yield pd.DataFrame(out, columns=["key", "event_id", "allowed", "reason", "retry_after"]).astype({"retry_after": "Int32"})

    rows = events.select("key", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t")).repartition("key").sortWithinPartitions("key", "t", "event_id")
    return rows.mapInPandas(run, DECISION)


def usage_limits_stream(events: DataFrame, rpm: int, daily: int) -> DataFrame:
    """The same decisions for a stream; the counters of a key are its state.  Events of a micro-batch are sorted first."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        counter = UsageCounter(rpm, daily, tuple(state.get) if state.exists else (-1.0, 0, -1, 0))
        rows = pd.concat(list(batches)).sort_values(["t", "event_id"])
        out = [(key[0], e, *counter.request(t)) for e, t in zip(rows["event_id"], rows["t"], strict=True)]
        state.update(counter.state())
        yield pd.DataFrame(out, columns=["key", "event_id", "allowed", "reason", "retry_after"]).astype({"retry_after": "Int32"})

    rows = events.select("key", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    return rows.groupBy("key").applyInPandasWithState(step, DECISION, STATE, "append", GroupStateTimeout.NoTimeout)


def failure_limiter(events: DataFrame, limit: int, seconds: int) -> DataFrame:
    """(key, event_id, failures, blocked, wait): failures (kind ``failure``) in the trailing window since the last ``success``, in
    order of second and event_id.

    wait is the time until the window holds fewer than ``limit`` again, at least 1.  A decision depends on the trailing window only,
    so a key's events are dealt out by slices of time, each with the events of one window before it: a hot key is split.
    """
    slice_ = max(16 * seconds, 3600)
    e = events.select("key", "event_id", F.unix_timestamp("ts").alias("t"), "kind")
    own = F.floor(F.col("t") / slice_)
    also = F.when(F.pmod("t", F.lit(slice_)) >= slice_ - seconds, F.array(own, own + 1)).otherwise(F.array(own))
    e = e.withColumn("own", own).withColumn("slice", F.explode(also))
    order = Window.partitionBy("key", "slice").orderBy("t", "event_id")
    e = e.withColumn("epoch", F.coalesce(F.sum((F.col("kind") == "success").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    epoch = Window.partitionBy("key", "slice", "epoch")
    so_far, failed = epoch.orderBy("t", "event_id").rowsBetween(Window.unboundedPreceding, 0), F.when(F.col("kind") == "failure", F.col("t"))
    before = epoch.orderBy("t").rangeBetween(Window.unboundedPreceding, -seconds)
    e = e.withColumn("failures", F.count(failed).over(so_far) - F.count(failed).over(before))
    # the failure that has to leave the window first: the limit-th last, carried on to the events after it
    e = e.withColumn("nth", F.lag("t", limit - 1).over(Window.partitionBy("key", "slice", "epoch", failed.isNull()).orderBy("t", "event_id")))
    oldest = F.last(F.when(failed.isNotNull(), F.struct("nth")), ignorenulls=True).over(so_far)["nth"]
    blocked = F.col("failures") >= limit
    wait = F.when(blocked, F.greatest(F.lit(1), oldest + seconds - F.col("t")).cast("int"))
    e = e.select("key", "event_id", "own", "slice", F.col("failures").cast("int").alias("failures"), blocked.alias("blocked"), wait.alias("wait"))
    return e.where("own = slice").drop("own", "slice")


def sliding_sessions(events: DataFrame, ttl_seconds: int) -> DataFrame:
    """(key, start, end, n): accesses less than ``ttl_seconds`` apart are one session; the end is the last access plus the time to live."""
    order = Window.partitionBy("key").orderBy("t")
    e = events.select("key", F.unix_timestamp("ts").alias("t"))
    e = e.withColumn("new", F.coalesce((F.col("t") - F.lag("t").over(order) >= ttl_seconds).cast("int"), F.lit(1)))
    e = e.withColumn("s", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return e.groupBy("key", "s").agg(F.min("t").alias("start"), (F.max("t") + ttl_seconds).alias("end"), F.count(F.lit(1)).alias("n")).drop("s")


def sliding_sessions_stream(events: DataFrame, ttl_seconds: int, late: str = "10 minutes") -> DataFrame:
    s = events.withWatermark("ts", late).groupBy("key", F.session_window("ts", f"{ttl_seconds} seconds")).agg(F.count(F.lit(1)).alias("n"))
    return s.select("key", F.unix_timestamp("session_window.start").alias("start"), F.unix_timestamp("session_window.end").alias("end"), "n")


def liveness(heartbeats: DataFrame, stale_seconds: int, now=None) -> DataFrame:
    """(key, last, stale): the latest heartbeat of each key against ``now`` (a column of seconds), else the current time.  Works on streams in update mode."""
    now = F.unix_timestamp() if now is None else now
    return heartbeats.groupBy("key").agg(F.max(F.unix_timestamp("ts")).alias("last")).select("key", "last", (now - F.col("last") > stale_seconds).alias("stale"))


def ingest_stream(files: DataFrame, target: str, checkpoint: str, chunker: Callable[[DataFrame], DataFrame] = recursive_chunks, max_bytes: int = 20_000_000) -> StreamingQuery:
    """New documents (doc_id, text) of a stream become chunks: admitted, hashed, each content once, cut by ``chunker``, appended.

    ``target/documents`` (doc_id, hash) is the index of all contents that were ever taken; a micro-batch is held against it, so repeats
    are found however late they come, and of equal texts in one micro-batch the smallest id is taken.  ``target/chunks`` gets what
    ``chunker`` makes of (doc_id, text).  Both are written by number of the micro-batch: one that is replayed replaces its own output and
    does not look at it.
    """
    size = F.octet_length(F.coalesce("text", F.lit("")))
    good = files.where((size > 0) & (size <= max_bytes)).withColumn("hash", content_hash(F.col("text")))

    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        first = batch.groupBy("hash").agg(F.min("doc_id").alias("doc_id"))
        if exists(spark, f"{target}/documents"):
            known = spark.read.parquet(f"{target}/documents").where(F.col("batch") < number).select("hash")
            first = first.join(known, "hash", "left_anti")
        first.select("doc_id", "hash").write.mode("overwrite").parquet(f"{target}/documents/batch={number}")
        taken = spark.read.parquet(f"{target}/documents/batch={number}")
        new = batch.join(taken, ["hash", "doc_id"], "left_semi").dropDuplicates(["hash"])
        chunker(new.select("doc_id", "text")).write.mode("overwrite").parquet(f"{target}/chunks/batch={number}")

    return good.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
