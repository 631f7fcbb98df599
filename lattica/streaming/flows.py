"""Structured Streaming forms of the stateful containers: windows, sessions, expiry, timers, deduplication."""

from __future__ import annotations

import bisect
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table's Parquet file (or folder) as a stream."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").option("recursiveFileLookup", "false").parquet(folder)


def drain(df: DataFrame, mode: str, folder: str, keys: list[str] | None = None) -> DataFrame:
    """Run a streaming query over what is available now and return its result.

    ``append`` results go to Parquet under ``folder``; of ``complete`` ones the last batch holds all.
    Of ``update`` ones each batch is kept and the last row of each of ``keys`` is the result.
    """
    name = uuid.uuid4().hex
    out, marks = f"{folder}/stream-{name}", f"{folder}/marks-{name}"
    if mode == "append":
        query = df.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start()
    else:
        put = lambda rows, batch: rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")
        query = df.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", marks).trigger(availableNow=True).start()
    query.awaitTermination()
    if mode == "append":
        return df.sparkSession.read.schema(df.schema).parquet(out)
    every = df.sparkSession.read.option("basePath", out).schema(StructType([*df.schema, StructField("batch", LongType())])).parquet(out)
    if mode == "complete":
        return every.where(F.col("batch") == every.agg(F.max("batch").alias("b")).scalar()).drop("batch")
    rest = [c for c in df.columns if c not in keys]
    got = every.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r"))
    return got.select(*[F.col(c) if c in keys else F.col(f"r.{c}").alias(c) for c in df.columns])


def windows(events: DataFrame, ts: str, width: str, keys: list[str], late: str) -> DataFrame:
    """Counts of tumbling windows with a watermark."""
    w = F.window(F.col(ts), width)
    return events.withWatermark(ts, late).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("bucket"), *keys, "n")


def sessions(events: DataFrame, ts: str, gap: str, keys: list[str], late: str) -> DataFrame:
    """Counts of sessions: runs of events of a key with gaps shorter than ``gap``."""
    w = F.session_window(F.col(ts), gap)
    return events.withWatermark(ts, late).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("started"), *keys, "n")


def distinct_within(events: DataFrame, ts: str, keys: list[str], late: str) -> DataFrame:
    """The first event of each key within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def expiring(events: DataFrame, key: str, ts_us: str, value: str, ttl_us: int) -> DataFrame:
    """(key, writes, expiries): a key's state is dropped when an event comes later than ``ttl_us`` after the last."""

    def step(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, writes, lapses = state.get if state.exists else (None, 0, 0)
        rows = pd.concat(list(frames)).sort_values([ts_us, value])
        for t in rows[ts_us]:
            if last is not None and t - last > ttl_us:
                lapses += 1
            last, writes = int(t), writes + 1
        state.update((last, writes, lapses))
        yield pd.DataFrame({key: [k[0]], "writes": [writes], "expiries": [lapses]})

    schema = f"{key} bigint, writes bigint, expiries bigint"
    return events.groupBy(key).applyInPandasWithState(step, schema, "last bigint, writes bigint, lapses bigint", "update", GroupStateTimeout.NoTimeout)


def timers(events: DataFrame, key: str, ts_us: str, period_us: int) -> DataFrame:
    """(key, fired): how often a repeating timer, started by a key's first event, has fired by its last event."""

    def step(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, last = state.get if state.exists else (None, None)
        rows = pd.concat(list(frames))[ts_us]
        first = int(rows.min()) if first is None else min(first, int(rows.min()))
        last = int(rows.max()) if last is None else max(last, int(rows.max()))
        state.update((first, last))
        yield pd.DataFrame({key: [k[0]], "fired": [(last - first) // period_us]})

    return events.groupBy(key).applyInPandasWithState(step, f"{key} bigint, fired bigint", "first bigint, last bigint", "update", GroupStateTimeout.NoTimeout)


def firing(events: DataFrame, ts: str, key: str, period_ms: int, late: str) -> DataFrame:
    """(key, fired_at, count): a repeating timer a key, on event time, started by its first event.

    A timer is due every ``period_ms`` after the first event; it fires when the watermark has passed, with the number of the
    key's events before the time it was due. After a period without any event the timer is unregistered and the state goes; a later event starts it
    anew. A batch that moves the watermark over several periods fires each of them.
    """

    def step(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        due, waiting = state.get if state.exists else (None, [])
        waiting = list(waiting)
        if not state.hasTimedOut:
            for f in frames:
                waiting += f["__ms"].tolist()
        waiting.sort()
        now, out = state.getCurrentWatermarkMs(), []
        if due is None and waiting:
            due = waiting[0] + period_ms
        while due is not None and due <= now:
            n = bisect.bisect_left(waiting, due)
            if n == 0:  # nothing since the last time: unregistered
                due = waiting[0] + period_ms if waiting else None
                continue
            out.append((due, n))
            waiting, due = waiting[n:], due + period_ms
        if due is None:
            state.remove()
        else:
            state.update((due, waiting))
            state.setTimeoutTimestamp(max(due, now + 1))
        yield pd.DataFrame({key: [k[0]] * len(out), "fired_at": [d for d, _ in out], "count": [n for _, n in out]}, dtype="int64")

    rows = events.withWatermark(ts, late).select(key, ts, F.unix_millis(ts).alias("__ms"))
    schema = f"{key} bigint, fired_at bigint, count bigint"
    return rows.groupBy(key).applyInPandasWithState(step, schema, "due bigint, waiting array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)


def lapsing(events: DataFrame, ts: str, key: str, ttl_ms: int, late: str) -> DataFrame:
    """(key, writes, lapsed_at): entries that no event refreshed for ``ttl_ms``, with the writes they had; their state is gone."""

    def step(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, writes, waiting = state.get if state.exists else (None, 0, [])
        waiting, out = list(waiting), []
        if not state.hasTimedOut:
            for f in frames:
                waiting += f["__ms"].tolist()
        waiting.sort()
        now = state.getCurrentWatermarkMs()
        for t in [t for t in waiting if t <= now]:
            if last is not None and t - last > ttl_ms:
                out.append((writes, last + ttl_ms))
                writes = 0
            last, writes = t, writes + 1
        waiting = [t for t in waiting if t > now]
        if last is not None and last + ttl_ms < now and not (waiting and waiting[0] - last <= ttl_ms):
            out.append((writes, last + ttl_ms))
            last, writes = None, 0
        if last is None and not waiting:
            state.remove()
        else:
            state.update((last, writes, waiting))
            state.setTimeoutTimestamp(max(now + 1, waiting[0] if last is None else last + ttl_ms + 1))
        yield pd.DataFrame({key: [k[0]] * len(out), "writes": [w for w, _ in out], "lapsed_at": [t for _, t in out]}, dtype="int64")

    rows = events.withWatermark(ts, late).select(key, ts, F.unix_millis(ts).alias("__ms"))
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} bigint, writes bigint, lapsed_at bigint", "last bigint, writes bigint, waiting array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)


#: Slots and width in milliseconds of the levels of a timer wheel; later timers overflow.
WHEEL = ((256, 1), (64, 256), (64, 256 * 64), (64, 256 * 64 * 64))


def wheel_slot(due_ms: Column, now_ms: Column) -> Column:
    """struct(level, slot) in which a timer wheel keeps a timer; level 4 is the overflow, and a timer that is due has level -1."""
    wait, out = due_ms - now_ms, F.struct(F.lit(len(WHEEL)).alias("level"), F.lit(0).cast("long").alias("slot"))
    for level, (slots, width) in reversed(list(enumerate(WHEEL))):
        slot = F.pmod(F.floor(due_ms / width), F.lit(slots)).cast("long")
        out = F.when(wait < slots * width, F.struct(F.lit(level).alias("level"), slot.alias("slot"))).otherwise(out)
    return F.when(wait <= 0, F.struct(F.lit(-1).alias("level"), F.lit(0).cast("long").alias("slot"))).otherwise(out)


def for_each_change(log: DataFrame, callback: Callable[[DataFrame, int], None], marks: str) -> None:
    """Hands every batch of a change log that is a stream to a callback, each batch once unless the callback failed in it."""
    log.writeStream.foreachBatch(callback).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
