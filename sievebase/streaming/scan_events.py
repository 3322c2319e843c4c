"""Scan status as streams.

Each function takes a streaming DataFrame of scan events (event_id, scan_id, ts,
status, progress) and gives a streaming DataFrame; batch input works too where
the result does not depend on state timers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

TERMINAL = ("COMPLETED", "FAILED")


def latest_status(events: DataFrame) -> DataFrame:
    """Current status per scan: the row with the greatest time and id."""
    last = F.max(F.struct("ts", "event_id", "status", "progress")).alias("r")
    return events.groupBy("scan_id").agg(last).select("scan_id", "r.ts", "r.event_id", "r.status", "r.progress")


class _Throttle(StatefulProcessor):
    """Held events are a list state that grows by appending; what was written last is a value state."""

    def __init__(self, seconds: float, waits: bool):
        self.seconds, self.waits = seconds, waits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "ts long, event_id long, status string, progress double")
        self.last = handle.getValueState("last", "status string, written long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        found = []
        for chunk in rows:
            chunk = chunk[chunk["event_id"].notna()]  # closing rows have none
            progress = [None if pd.isna(p) else float(p) for p in chunk["progress"]]
            found += zip((chunk["ts"].astype("int64") // 1000).tolist(), chunk["event_id"].astype("int64").tolist(), chunk["status"].tolist(), progress)
        if not self.waits:
            yield self.chosen(key, found)
        elif found:
            self.held.appendList(found)
            self.wake(min(r[0] for r in found), timerValues)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        ready, rest = [], []
        for row in self.held.get():
            (ready if row[0] <= passed else rest).append(tuple(row))
        if not ready:
            return
        if rest:
            self.held.put(rest)
            self.wake(min(r[0] for r in rest), timerValues)
        else:
            self.held.clear()
        yield self.chosen(key, ready)

    def wake(self, ts: int, timers: TimerValues) -> None:
        self.handle.registerTimer(max(-(-ts // 1000), timers.getCurrentWatermarkInMs() + 1))

    def chosen(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        status, written = self.last.get() if self.last.exists() else (None, None)
        found = []
        for row in sorted(rows, key=lambda r: r[:2]):
            if row[2] != status or row[0] - written >= self.seconds * 1_000_000:
                found.append(row)
                status, written = row[2], row[0]
        if found:
            self.last.update((status, written))
        out = pd.DataFrame(found, columns=["ts", "event_id", "status", "progress"]).assign(scan_id=key[0])
        out["ts"] = pd.to_datetime(out["ts"].astype("int64"), unit="us")
        return out[["event_id", "scan_id", "ts", "status", "progress"]]


def progress_throttle(events: DataFrame, seconds: float = 10.0, delay: str | None = None) -> DataFrame:
    """Events worth writing: the status changed or the last write is old enough.

    With ``delay`` events wait in the state of their scan until the watermark has
    passed them and are then taken in order of time and id, so the result doesn't
    depend on how the input is cut into micro-batches. Events later than ``delay``
    are dropped; those that the watermark hasn't passed are still held (see
    ``runner.drain_closed``). Without ``delay`` nothing waits: events are put in
    order within a micro-batch only, which is right for input in order of time.
    The state needs RocksDB (``session.configure``).
    """
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return (
        (events.withWatermark("ts", delay) if delay else events)
        .groupBy("scan_id")
        .transformWithStateInPandas(
            _Throttle(seconds, bool(delay)), "event_id long, scan_id long, ts timestamp, status string, progress double",
            "append", "EventTime" if delay else "None",
        )
    )


class _Watch(StatefulProcessor):
    """The last event of a scan, and one timer that fires if nothing follows it in time."""

    def __init__(self, idle_seconds: int):
        self.idle_ms = idle_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "last_ms long, status string, timer long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = self.last.get() if self.last.exists() else (-1, "", None)
        timer = last[2]
        for chunk in rows:
            top = chunk.assign(ms=chunk["ts"].astype("int64") // 1_000_000).sort_values(["ts", "event_id"]).iloc[-1]
            if int(top["ms"]) >= last[0]:
                last = (int(top["ms"]), top["status"])
        due = max(last[0] + self.idle_ms, timerValues.getCurrentWatermarkInMs() + 1)
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        self.last.update((last[0], last[1], due))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last_ms, status, _ = self.last.get()
        self.last.clear()
        if status not in TERMINAL:
            yield pd.DataFrame({"scan_id": [key[0]], "last_ms": [last_ms], "status": [status]})


def orphan_scans(events: DataFrame, idle_seconds: int, delay: str = "1 hour") -> DataFrame:
    """Scans whose last status is a running stage and that stay silent too long.

    An event-time timer per scan fires when the watermark passes its last event
    by ``idle_seconds``; a later event moves it.
    """
    return (
        events.withWatermark("ts", delay)
        .groupBy("scan_id")
        .transformWithStateInPandas(_Watch(idle_seconds), "scan_id long, last_ms long, status string", "append", "EventTime")
    )


def status_windows(events: DataFrame, length: str = "1 day", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Events per status in tumbling windows, or sliding ones if ``slide`` is given."""
    span = F.window("ts", length, slide) if slide else F.window("ts", length)
    return (
        events.withWatermark("ts", delay).groupBy(span.alias("w"), "status")
        .agg(F.count("*").alias("events"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "status", "events")
    )


def scan_sessions(events: DataFrame, gap: str = "6 hours", delay: str = "1 hour") -> DataFrame:
    """Bursts of events of a scan, given out once they are closed."""
    return (
        events.withWatermark("ts", delay).groupBy("scan_id", F.session_window("ts", gap).alias("w"))
        .agg(F.count("*").alias("events"))
        .select("scan_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")
    )


def dedup(events: DataFrame, *keys: str, delay: str = "60 days") -> DataFrame:
    """Keys seen, each once within the watermark delay.

    A key that comes again in a later micro-batch, after the watermark has passed
    its first event by ``delay``, is given again, and events later than the
    watermark are dropped. So it equals a batch DISTINCT if all input is one
    micro-batch or spans less than ``delay``.
    """
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(keys)).select(*keys)


def running_scans(scans: DataFrame, by: list[str], slices: int | None = None) -> DataFrame:
    """Scans running when each scan starts, overall or per group.

    ``scans`` has event_id, start_us and end_us. Starts count +1 and ends -1. The
    time axis is cut at quantiles of the starts, so the running sums are taken
    within slices of about equal size; the sums of earlier slices come from a
    table with one row per group and slice. There are as many slices as shuffle
    partitions unless told otherwise.
    """
    if slices is None:
        slices = int(scans.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = scans.approxQuantile("start_us", [i / slices for i in range(1, slices)], 0.1 / slices)
    bounds = F.array(*[F.lit(int(c)) for c in sorted(set(cuts))])

    def steps(kind: int, at: str) -> DataFrame:
        return scans.select(*by, "event_id", F.col(at).alias("at"), F.lit(kind).alias("step"))

    moves = steps(1, "start_us").unionByName(steps(-1, "end_us"))
    moves = moves.withColumn("slice", F.size(F.filter(bounds, lambda b: b <= F.col("at"))))
    group = [F.lit(0).alias("_g")] if not by else [F.col(c) for c in by]
    per_slice = moves.groupBy(*by, "slice").agg(F.sum("step").alias("net"))
    earlier = Window.partitionBy(*group).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    before = per_slice.select(*by, "slice", F.coalesce(F.sum("net").over(earlier), F.lit(0)).alias("before"))
    order = Window.partitionBy(*by, "slice").orderBy("at", "step", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    joined = moves.join(before, [*by, "slice"])
    return joined.withColumn("running", F.col("before") + F.sum("step").over(order)).filter(F.col("step") == 1).select(
        *by, "event_id", F.col("at").alias("start_us"), "running"
    )


def concurrent_scans(scans: DataFrame, limit: int = 3, per_client: int = 1) -> DataFrame:
    """Starts above the limits: at most three at once, at most one per client."""
    over = running_scans(scans, []).filter(F.col("running") > limit).withColumn("rule", F.lit("global"))
    own = running_scans(scans, ["client"]).filter(F.col("running") > per_client).withColumn("rule", F.lit("client"))
    cols = ["event_id", "start_us", "running", "rule"]
    return over.select(*cols).unionByName(own.select(*cols))


def interval_bounds(start: Column, minutes: Column) -> tuple[Column, Column]:
    """Start and end of a scan in microseconds."""
    start_us = F.unix_micros(start.cast("timestamp"))
    return start_us, start_us + F.floor(minutes * 60).cast("bigint") * 1_000_000
