"""Streams of telemetry: validation, deduplication, session counts, idempotent batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues


def valid_rows(stream: DataFrame, reason: Column) -> DataFrame:
    """Rows without a reason against them."""
    return stream.filter(reason.isNull())


def with_event_time(stream: DataFrame, ts_ms: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Event time and watermark from a time in ms."""
    return stream.withColumn("event_time", F.timestamp_millis(ts_ms)).withWatermark("event_time", late)


def once_per_list(stream: DataFrame) -> DataFrame:
    """Impressions repeated for one list go within the watermark."""
    return stream.dropDuplicatesWithinWatermark(["client_id", "session_id", "event_id", "position", "ranking"])


def session_counts(stream: DataFrame, gap: str = "5 seconds") -> DataFrame:
    """Impressions per client, session and burst."""
    g = stream.groupBy("client_id", "session_id", F.session_window("event_time", gap).alias("w")).agg(F.count("*").alias("n"))
    return g.select("client_id", "session_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def append_once(folder: str):
    """A batch writer that replaces its own batch on a retry."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return write


def settled_batches(stream: DataFrame, settle: str = "700 milliseconds"):
    """A writer that gathers what arrives within ``settle`` to one batch."""
    return stream.writeStream.trigger(processingTime=settle)


def in_batches(rows: DataFrame, by: str, order: str, most: int = 50) -> DataFrame:
    """``batch``: the number of a row's batch of at most ``most`` rows of its client."""
    from pyspark.sql import Window as W

    return rows.withColumn("batch", F.floor((F.row_number().over(W.partitionBy(by).orderBy(order)) - 1) / most))


def clock_reason(ts_ms: Column, now_ms: Column, first_ms: int = 1_600_000_000_000, ahead_ms: int = 600_000) -> Column:
    """Why a row's time is refused: before the first, or more than ten minutes ahead."""
    return F.when(ts_ms < first_ms, "old").when(ts_ms > now_ms + ahead_ms, "future")


def within_retention(rows: DataFrame, ts_ms: str, now_ms: Column, days: int = 90) -> DataFrame:
    """Rows of the last ``days``; on a table partitioned by day the condition prunes it."""
    return rows.filter(F.col(ts_ms) >= now_ms - days * 86_400_000)


def identity_period(client: str, ts_ms: str, days: int = 7) -> Column:
    """Number of the ``days`` period in which a client keeps its identity, counted from its first row."""
    from pyspark.sql import Window as W

    return F.floor((F.col(ts_ms) - F.min(ts_ms).over(W.partitionBy(client))) / (days * 86_400_000))


def swept_records(sweeps: DataFrame, budget: int = 3) -> DataFrame:
    """``url, state, missed`` per sweep from a stream of ``url, sweep, found``: a record missed more than ``budget`` times in a row is removed.

    The state of a record is its count of misses; rows of one record come in order of
    their sweeps within a batch.
    """

    def of(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        missed = state.get[0] if state.exists else 0
        out = []
        for r in pd.concat(list(frames)).sort_values("sweep").itertuples():
            missed = 0 if r.found else missed + 1
            out.append((key[0], r.sweep, "present" if r.found else "removed" if missed > budget else "carried", missed))
        state.update((missed,))
        yield pd.DataFrame(out, columns=["url", "sweep", "state", "missed"])

    return sweeps.groupBy("url").applyInPandasWithState(of, "url string, sweep long, state string, missed int", "missed int", "append", GroupStateTimeout.NoTimeout)


class RenderCutter(StatefulProcessor):
    """Cuts a session's impressions into renders as batches do: in order of time and position.

    Rows wait in state until the watermark has passed them, since an earlier one may still
    come; a timer at the first waiting row's time wakes the session. What is kept besides
    is the open render alone: its number, the positions it has shown and its last time.
    """

    def __init__(self, gap_ms: int):
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        """Three pieces of state."""
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts long, position int, event_id string")
        self.open = handle.getValueState("open", "render int, seen array<int>, last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803  Spark's names
        """Keep what comes, and wake when the watermark reaches it."""
        for f in rows:
            self.waiting.appendList([(int(r.ts), int(r.position), str(r.event_id)) for r in f.itertuples()])
            self.handle.registerTimer(int(f["ts"].min()))
        yield from ()

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        """Number everything up to the watermark, and wait for the first row beyond it."""
        passed = timerValues.getCurrentWatermarkInMs()
        rows = sorted(self.waiting.get())
        due, rest = [r for r in rows if r[0] <= passed], [r for r in rows if r[0] > passed]
        if not due:
            return
        render, seen, last = self.open.get() if self.open.exists() else (0, [], 0)
        seen, out = set(seen), []
        for ts, position, event_id in due:
            if not render or position in seen or ts - last > self.gap_ms:
                render, seen = render + 1, set()
            seen.add(position)
            last = ts
            out.append((*key, render, ts, position, event_id))
        self.open.update((render, sorted(seen), last))
        self.waiting.clear()
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(rest[0][0])
        yield pd.DataFrame(out, columns=["client_id", "session_id", "render", "ts", "position", "event_id"])

    def close(self) -> None:
        """Nothing to let go of."""


def cut_renders(stream: DataFrame, gap_ms: int = 5000) -> DataFrame:
    """``client_id, session_id, render, ts, position, event_id`` of a stream with a watermark on ``event_time``: renders as :func:`brightquay.operators.telemetry.renders` cuts them.

    Rows later than the watermark are dropped by Spark. The session needs the RocksDB state
    store (``spark.sql.streaming.stateStore.providerClass``).
    """
    shaped = stream.select(F.col("client_id").cast("string"), F.col("session_id").cast("string"), F.col("ts").cast("long"), F.col("position").cast("int"), F.col("event_id").cast("string"), "event_time")
    return shaped.groupBy("client_id", "session_id").transformWithStateInPandas(RenderCutter(gap_ms), "client_id string, session_id string, render int, ts long, position int, event_id string", "append", "EventTime")


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
