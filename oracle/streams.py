"""Comparison SQL: what the streams must give, as batch statements."""

from __future__ import annotations

from oracle.base import sql
from oracle.corpus import SECURITY_CTES


def statements() -> dict[str, str]:
    out: dict[str, str] = {}
    out["stream_latest_status"] = sql("scan_events", """
SELECT scan_id, event_id, status, progress, epoch_us(ts) AS ts_us FROM scan_events
QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY ts DESC, event_id DESC) = 1""")
    out["stream_progress_throttle"] = sql("scan_events", "SELECT event_id, scan_id, status, us AS ts_us FROM walk WHERE written",
        seq="SELECT event_id, scan_id, status, epoch_us(ts) AS us, row_number() OVER (PARTITION BY scan_id ORDER BY ts, event_id) AS n FROM scan_events",
        walk="""SELECT event_id, scan_id, status, us, n, true AS written, status AS last_status, us AS last_us FROM seq WHERE n = 1
  UNION ALL (SELECT s.event_id, s.scan_id, s.status, s.us, s.n, s.status <> w.last_status OR s.us - w.last_us >= 86400000000,
    s.status, CASE WHEN s.status <> w.last_status OR s.us - w.last_us >= 86400000000 THEN s.us ELSE w.last_us END
  FROM walk w JOIN seq s ON s.scan_id = w.scan_id AND s.n = w.n + 1)""")
    out["stream_orphan_scans"] = sql("scan_events", """
SELECT scan_id, status, last_us // 1000 AS last_ms FROM (
  SELECT scan_id, arg_max(status, (ts, event_id)) AS status, max(epoch_us(ts)) AS last_us FROM scan_events GROUP BY scan_id)
WHERE status NOT IN ('COMPLETED', 'FAILED')
  AND last_us // 1000 + 21600 * 1000 <= (SELECT max(epoch_us(ts)) // 1000 - 3600 * 1000 FROM scan_events)""")
    out["stream_rule_scan"] = sql("lines", """
SELECT repo, file_path, line_number, severity, category, title, effort_level, confidence_score FROM security""", **SECURITY_CTES)
    win = "epoch_us(s) AS window_start_us, epoch_us(s + INTERVAL 1 DAY) AS window_end_us, status, count(*) AS events"
    out["stream_status_windows"] = sql("scan_events", f"SELECT {win} FROM (SELECT date_trunc('day', ts) AS s, status FROM scan_events) GROUP BY s, status")
    out["stream_status_sliding"] = sql("scan_events", f"""
SELECT {win} FROM (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2000-01-01') - INTERVAL (6 * k) HOUR AS s, status
  FROM scan_events, range(0, 4) t(k)) GROUP BY s, status""")
    out["stream_scan_sessions"] = sql("scan_events", """
SELECT scan_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 21600000000 AS end_us, count(*) AS events FROM (
  SELECT *, sum(new) OVER (PARTITION BY scan_id ORDER BY ts, event_id) AS s FROM (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY scan_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM scan_events))
GROUP BY scan_id, s
HAVING (epoch_us(max(ts)) + 21600000000) // 1000 <= (SELECT max(epoch_us(ts)) // 1000 - 3600 * 1000 FROM scan_events)""")
    out["stream_dedup"] = sql("scan_events", "SELECT DISTINCT scan_id, status FROM scan_events")
    sweep = """SELECT event_id, start_us, CAST(running AS BIGINT) AS running, '{0}' AS rule FROM (SELECT *, sum(step) OVER ({1} ORDER BY at_us, step, event_id
  ROWS UNBOUNDED PRECEDING) AS running FROM moves) WHERE step = 1 AND running > {2}"""
    out["concurrent_scans"] = sql("", sweep.format("global", "", 3) + " UNION ALL " + sweep.format("client", "PARTITION BY user_id", 1),
        iv="SELECT event_id, user_id, epoch_us(ts) AS s, epoch_us(ts) + CAST(floor(value * 60) AS BIGINT) * 1000000 AS e FROM events",
        moves="SELECT event_id, user_id, s AS at_us, s AS start_us, 1 AS step FROM iv UNION ALL SELECT event_id, user_id, e, s, -1 FROM iv")
    return out
