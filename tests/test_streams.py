"""Streams fed by several files, one per micro-batch."""

import datetime as dt

from sievebase.streaming import runner, scan_events

SCHEMA = "event_id long, scan_id long, ts timestamp, status string, progress double"
T0 = dt.datetime(2024, 1, 1)


def feed(spark, folder, batches):
    """Write one parquet file per batch, oldest first, and stream them one by one."""
    import os

    n = 0
    for i, batch in enumerate(batches):
        rows = []
        for scan, seconds, status in batch:
            rows.append((n, scan, T0 + dt.timedelta(seconds=seconds), status, 0.0))
            n += 1
        path = str(folder / f"b{i}")
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(path)
        for name in os.listdir(path):
            os.utime(os.path.join(path, name), (1_600_000_000 + i * 100, 1_600_000_000 + i * 100))
    return (
        spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.parquet").parquet(str(folder))
    )


def test_throttle_keeps_its_state_between_batches(spark, tmp_path):
    events = feed(spark, tmp_path, [[(1, 0, "A"), (1, 5, "A")], [(1, 9, "A"), (1, 11, "A"), (1, 12, "B")], [(1, 13, "B"), (2, 0, "B")]])
    kept = runner.drain_append(scan_events.progress_throttle(events, 10), "t")
    assert sorted(r.event_id for r in kept.collect()) == [0, 3, 4, 6]


def test_throttle_is_the_same_in_any_micro_batches(spark, tmp_path):
    """Late files and many micro-batches give what one batch in order gives; without closing, what the watermark passed."""
    rows = [(scan, (k * 37 + scan) % 100, "AB"[(k * 37 + scan) % 100 // 30 % 2]) for k in range(40) for scan in (1, 2)]
    want = set()
    for scan in (1, 2):
        status, written = None, None
        for _, second, current in sorted(r for r in rows if r[0] == scan):
            if current != status or second - written >= 10:
                want.add((scan, second))
                status, written = current, second
    for name, step in (("one", 80), ("many", 16)):
        (tmp_path / name).mkdir()
        events = feed(spark, tmp_path / name, [rows[a : a + step] for a in range(0, 80, step)])
        got = runner.drain_closed(events, lambda e: scan_events.progress_throttle(e, 10, "100 seconds"), "ts", "t").collect()
        assert sorted((r.scan_id, (r.ts - T0).seconds) for r in got) == sorted(want)


def test_throttle_gives_what_the_watermark_passed(spark, tmp_path):
    events = feed(spark, tmp_path, [[(1, 20, "A")], [(1, 10, "B"), (1, 0, "A")], [(1, 100, "A")]])
    kept = runner.drain_append(scan_events.progress_throttle(events, 60, "30 seconds"), "t")
    assert sorted(r.event_id for r in kept.collect()) == [0, 1, 2]


def test_latest_status_takes_the_last_batch(spark, tmp_path):
    events = feed(spark, tmp_path, [[(1, 0, "A"), (2, 0, "A")], [(1, 9, "B")], [(1, 5, "C")]])
    rows = runner.latest_rows(runner.drain_update(scan_events.latest_status(events), "t"), "scan_id")
    assert {r.scan_id: r.status for r in rows.collect()} == {1: "B", 2: "A"}


def test_late_rows_are_dropped_from_windows(spark, tmp_path):
    day = 86400
    events = feed(spark, tmp_path, [[(1, 0, "A")], [(1, 3 * day, "A")], [(1, 4 * day, "A")], [(1, 10, "A")]])
    rows = runner.latest_rows(
        runner.drain_update(scan_events.status_windows(events), "t"), "window_start", "window_end", "status"
    )
    assert {r.window_start: r.events for r in rows.collect()}[T0] == 1


def test_duplicates_across_batches_are_given_once(spark, tmp_path):
    events = feed(spark, tmp_path, [[(1, 0, "A"), (1, 1, "A")], [(1, 2, "A"), (2, 3, "A")]])
    rows = runner.drain_append(scan_events.dedup(events, "scan_id", "status", delay="1 hour"), "t")
    assert sorted(r.scan_id for r in rows.collect()) == [1, 2]


def test_silent_running_scans_are_orphans(spark, tmp_path):
    hour = 3600
    events = feed(spark, tmp_path, [[(1, 0, "ANALYSIS"), (2, 0, "COMPLETED"), (3, 0, "ANALYSIS")], [(3, 5 * hour, "ANALYSIS")], [(4, 9 * hour, "REPORT")]])
    rows = runner.drain_append(scan_events.orphan_scans(events, 4 * hour), "t")
    assert [r.scan_id for r in rows.collect()] == [1]
