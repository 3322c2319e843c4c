"""Comparison SQL: dashboards and accounts."""

from __future__ import annotations

from oracle.base import sql

NAME = "coalesce(nullif(repository_name, ''), CAST(scan_id AS VARCHAR))"
SCORE = "coalesce(health_score, 0)"
DONE = "status = 'COMPLETED'"
NEW = "created_at DESC, scan_id DESC"
COUNTS = """SELECT scan_id, count(*) AS total_issues, count(*) FILTER (severity = 'Critical') AS critical,
  count(*) FILTER (severity = 'Warning') AS warning, count(*) FILTER (severity = 'Info') AS info FROM issues GROUP BY scan_id"""


def newest(n: int, by: str = "user_id", src: str = "scans", where: str = DONE) -> str:
    return f"(SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {NEW}) AS rank FROM {src} WHERE {where} QUALIFY rank <= {n})"


def statements() -> dict[str, str]:
    out: dict[str, str] = {}
    cnt = {"cnt": COUNTS}
    out["scan_state_json"] = sql("issues", COUNTS)
    fld = "CASE WHEN regexp_matches({0}, '^[=+\\-@]') THEN '''' ELSE '' END || replace({0}, '\"', '\"\"')"
    out["findings_csv_export"] = sql("issues", f"""SELECT scan_id, '"' || severity || '","' || category || '","' || {fld.format('title')} || '","'
  || {fld.format('file_path')} || '",' || line_number || ',' || confidence_score || ',"' || {fld.format("replace(suggestion, chr(10), ' ')")} || '"' AS csv_line FROM issues""")
    out["user_export"] = sql("scans", """
SELECT user_id, count(*) OVER (PARTITION BY user_id) AS total_scans,
  '{"scan_id":' || scan_id || ',"status":"' || status || '"' || CASE WHEN health_score IS NULL THEN '' ELSE ',"health_score":' || health_score END
  || ',"created_at":"' || strftime(created_at, '%Y-%m-%d %H:%M:%S') || '"}' AS scan_json FROM scans""")
    out["recent_completed"] = sql("scans", f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {NEW}) AS rank FROM (
  SELECT * FROM (SELECT *, 0 AS store FROM {newest(10, where=DONE + ' AND scan_id % 3 <> 0')}
    UNION ALL SELECT * REPLACE (1 AS health_score), 1 AS store FROM {newest(10)})
  QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY store) = 1)) WHERE rank <= 10""".replace(
        "SELECT *, 0 AS store FROM", "SELECT * EXCLUDE (rank), 0 AS store FROM").replace(
        "SELECT * REPLACE (1 AS health_score), 1 AS store", "SELECT * EXCLUDE (rank) REPLACE (1 AS health_score), 1 AS store"))
    out["scan_history"] = sql("scans", f"""SELECT user_id, scan_id, {NAME} AS repository_name, {SCORE} AS score, status, created_at, rank FROM {newest(10)}""")
    cards = f"""SELECT r.user_id, r.scan_id, {NAME.replace('scan_id', 'r.scan_id')} AS name, {SCORE} AS coverage,
  CASE WHEN {SCORE} >= 80 THEN 'HEALTHY' WHEN {SCORE} >= 50 THEN 'NOMINAL' ELSE 'CRITICAL' END AS tier,
  coalesce(critical, 0) AS critical_count, coalesce(warning, 0) AS warning_count, created_at
FROM {newest(10)} r LEFT JOIN cnt ON cnt.scan_id = r.scan_id"""
    out["repo_cards"] = sql("scans issues", cards, **cnt)
    out["user_scan_stats"] = sql("scans issues", f"""
SELECT user_id, total_scans, scores // total_scans AS avg_score, total_issues, critical_issues, CAST(floor(hours) AS BIGINT) AS debt_hours,
  CAST(hours * 85 AS DOUBLE) AS debt_dollars FROM (
  SELECT user_id, count(*) AS total_scans, CAST(sum({SCORE}) AS BIGINT) AS scores, CAST(sum(coalesce(total_issues, 0)) AS BIGINT) AS total_issues,
    CAST(sum(coalesce(critical, 0)) AS BIGINT) AS critical_issues,
    CAST(sum(coalesce(critical, 0) * 4.0 + coalesce(warning, 0) * 1.5 + coalesce(info, 0) * 0.5) AS DOUBLE) AS hours
  FROM {newest(100)} r LEFT JOIN cnt ON cnt.scan_id = r.scan_id GROUP BY user_id)""", **cnt)
    out["admin_stats"] = sql("scans issues users api_keys", f"""
SELECT (SELECT count(*) FROM users) AS total_users, (SELECT count(*) FROM scans) AS total_scans, (SELECT count(*) FROM api_keys) AS total_api_keys,
  (SELECT count(*) FROM issues JOIN scans USING (scan_id) WHERE {DONE} AND severity = 'Critical') AS total_critical,
  (SELECT count(*) FROM issues JOIN scans USING (scan_id) WHERE {DONE}) AS total_issues,
  (SELECT count(DISTINCT repository_name) FROM scans WHERE {DONE}) AS total_repos,
  (SELECT count(*) FROM scans WHERE {DONE}) AS completed_scans,
  (SELECT CAST(sum({SCORE}) // count(*) AS BIGINT) FROM scans WHERE {DONE}) AS avg_health_score""")
    out["admin_users"] = sql("scans users", """
SELECT u.*, coalesce(n, 0) AS total_scans FROM users u LEFT JOIN (SELECT user_id, count(*) AS n FROM scans GROUP BY user_id) s USING (user_id)
WHERE contains(lower(email), 'customer#0') OR contains(lower(display_name), 'customer#0')""")
    out["admin_scans_page"] = sql("scans issues", f"""
SELECT CAST(position AS INT) AS position, h.scan_id, status, repository_name, user_id, created_at, {SCORE} AS score, coalesce(total_issues, 0) AS total_issues,
  coalesce(critical, 0) AS critical_issues, total FROM (
  SELECT *, count(*) OVER () AS total, row_number() OVER (ORDER BY health_score DESC NULLS LAST, scan_id) AS position FROM scans WHERE (contains(CAST(scan_id AS VARCHAR), 'repo_1') OR contains(repository_name, 'repo_1'))
    AND status = 'COMPLETED' ORDER BY health_score DESC NULLS LAST, scan_id LIMIT 50 OFFSET 100) h LEFT JOIN cnt ON cnt.scan_id = h.scan_id""", **cnt)
    out["activity_feed"] = sql("scans users", f"""
SELECT * FROM (SELECT 'SCAN' AS type, CASE status WHEN 'COMPLETED' THEN 'check_circle' WHEN 'FAILED' THEN 'error' ELSE 'sync' END AS icon,
    {NAME} || ' — ' || status AS message, created_at AS timestamp, health_score AS score FROM scans ORDER BY {NEW} LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'USER', 'person', 'User logged in: ' || email, last_login, 0 FROM users ORDER BY last_login DESC, user_id LIMIT 5)""")
    out["notifications"] = sql("scans", "SELECT *, created_at > TIMESTAMP '1998-01-01 00:00:00' AS is_unread FROM n",
        r=f"SELECT * FROM {newest(5)}", n=f"""
  SELECT user_id, CAST(scan_id AS VARCHAR) AS scan_id, 'complete' AS kind, 'Scan complete — ' || {NAME} || ' scored ' || {SCORE} AS message, created_at FROM r
  UNION ALL SELECT user_id, CAST(scan_id AS VARCHAR), 'critical', 'New critical issue found in ' || {NAME}, created_at + INTERVAL 1 MINUTE FROM r WHERE {SCORE} < 80
  UNION ALL SELECT DISTINCT user_id, 'report', 'report', 'Monthly code health report ready', TIMESTAMP '2000-12-31 00:00:00' FROM r""")
    out["repo_search_sort"] = sql("scans issues", f"SELECT * FROM ({cards}) WHERE contains(lower(name), 'repo_2') OR contains(CAST(scan_id AS VARCHAR), 'repo_2')", **cnt)
    two = f"""SELECT repository_name, max(scan_id) FILTER (rank = 2) AS scan_a, max(scan_id) FILTER (rank = 1) AS scan_b
FROM {newest(2, 'repository_name', where=DONE + " AND repository_name <> ''")} GROUP BY repository_name HAVING count(*) = 2"""
    out["latest_two_scans"] = sql("scans", two)
    diff = {
        "two": two,
        "ka": "SELECT DISTINCT repository_name, file_path, title FROM two JOIN issues ON scan_id = scan_a",
        "kb": "SELECT DISTINCT repository_name, file_path, title FROM two JOIN issues ON scan_id = scan_b",
        "diff": "SELECT *, 'fixed' AS change FROM (FROM ka EXCEPT FROM kb) UNION ALL SELECT *, 'new' FROM (FROM kb EXCEPT FROM ka)",
    }
    out["scan_diff"] = sql("scans issues", "SELECT * FROM diff", **diff)
    out["scan_diff_summary"] = sql("scans issues", f"""
SELECT repository_name, b.sc - a.sc AS score_delta, b.c - a.c AS critical_delta, b.w - a.w AS warning_delta,
  coalesce(f, 0) AS fixed_count, coalesce(n, 0) AS new_count
FROM two JOIN side a ON a.scan_id = scan_a JOIN side b ON b.scan_id = scan_b
LEFT JOIN (SELECT repository_name, count(*) FILTER (change = 'fixed') AS f, count(*) FILTER (change = 'new') AS n FROM diff GROUP BY 1) USING (repository_name)""",
        **diff, **cnt, side=f"SELECT s.scan_id, {SCORE} AS sc, coalesce(critical, 0) AS c, coalesce(warning, 0) AS w FROM scans s LEFT JOIN cnt USING (scan_id)")
    out["score_trend"] = sql("scans", f"""
SELECT repository_name, scan_id, n - rank AS i, 100.0::DOUBLE / (n - 1) * (n - rank) AS x, 40 - {SCORE} * 0.4::DOUBLE AS y FROM (
  SELECT *, count(*) OVER (PARTITION BY repository_name) AS n FROM {newest(5, 'repository_name', where=DONE + " AND repository_name <> ''")}) WHERE n >= 2""")
    out["top_affected_files"] = sql("issues", """
SELECT scan_id, file_path, findings, CAST(round_even(findings / total * 100, 0) AS INT) AS percentage, rank FROM (
  SELECT *, sum(findings) OVER (PARTITION BY scan_id) AS total, row_number() OVER (PARTITION BY scan_id ORDER BY findings DESC, file_path) AS rank
  FROM (SELECT scan_id, file_path, count(*) AS findings FROM issues GROUP BY ALL)) WHERE rank <= 10""")
    out["severity_category_matrix"] = sql("issues", """SELECT CASE WHEN grouping(severity) = 1 THEN 'ALL' ELSE severity END AS severity, CASE WHEN grouping(category) = 1 THEN 'ALL' ELSE category END AS category, count(*) AS findings
FROM issues GROUP BY CUBE (severity, category)""")
    cols = "scan_id, severity, title, file_path, line_number"
    out["report_sections"] = sql("issues", f"""
SELECT {cols}, 'security' AS section, CASE severity WHEN 'Critical' THEN 0 ELSE 1 END AS position FROM issues WHERE category = 'Security'
UNION ALL SELECT {cols}, 'quality', 0 FROM issues WHERE category IN ('Quality', 'Performance')
UNION ALL SELECT {cols}, 'suggestions', rk FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY severity <> 'Critical', file_path, line_number, title, severity) AS rk
  FROM issues WHERE suggestion <> '') WHERE rk <= 10
UNION ALL SELECT {cols}, 'criticals', rk FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY file_path, line_number, title, severity) AS rk
  FROM issues WHERE severity = 'Critical') WHERE rk <= 5""")
    out["plan_quota"] = sql("quota_walk", """
SELECT user_id, plan_type, start AS period_start, max(used) AS used, CASE plan_type WHEN 'FREE' THEN 3 ELSE -1 END AS scan_limit,
  CASE plan_type WHEN 'FREE' THEN greatest(0, 3 - max(used)) ELSE -1 END AS remaining,
  count(*) FILTER (reason = 'limit reached') AS over_limit, count(*) FILTER (reason = 'private repository') AS private
FROM quota_walk WHERE n > 0 GROUP BY user_id, plan_type, start""")
    out["quota_rejections"] = sql("quota_walk", "SELECT user_id, start AS period_start, scan_id, reason FROM quota_walk WHERE reason IS NOT NULL")
    out["monthly_quota"] = sql("scans users", """
SELECT user_id, month, plan_type, used, CASE plan_type WHEN 'FREE' THEN 3 ELSE -1 END AS scan_limit,
  CASE plan_type WHEN 'FREE' THEN greatest(0, 3 - used) ELSE -1 END AS remaining,
  CASE plan_type WHEN 'FREE' THEN greatest(0, used - 3) ELSE 0 END AS rejected
FROM (SELECT user_id, strftime(created_at, '%Y-%m') AS month, count(*) AS used FROM scans GROUP BY ALL) JOIN users USING (user_id)""")
    out["monthly_rejections"] = sql("scans users", """
SELECT user_id, month, scan_id, 'monthly limit reached' AS reason FROM (
  SELECT *, strftime(created_at, '%Y-%m') AS month FROM scans JOIN (SELECT user_id FROM users WHERE plan_type = 'FREE') USING (user_id))
QUALIFY row_number() OVER (PARTITION BY user_id, month ORDER BY created_at, scan_id) > 3""")
    out["cascade_delete"] = sql("scans users", "SELECT * FROM scans WHERE user_id NOT IN (SELECT user_id FROM users WHERE plan_type = 'TEAM')")
    out["user_upsert"] = sql("users logins", """
SELECT coalesce(m.user_id, u.user_id) AS user_id, coalesce(m.email, u.email) AS email, coalesce(plan_type, 'FREE') AS plan_type,
  CASE WHEN m.user_id IS NULL THEN last_login ELSE TIMESTAMP '2025-06-01 00:00:00' END AS last_login,
  CASE WHEN m.user_id IS NULL THEN 'kept' WHEN u.user_id IS NULL THEN 'inserted' ELSE 'updated' END AS action
FROM users u FULL JOIN m ON m.old_id = u.user_id""", m="""SELECT user_id, email, old_id FROM (
  SELECT l.user_id, l.email, coalesce(a.user_id, b.user_id) AS old_id,
    row_number() OVER (PARTITION BY coalesce(a.user_id, b.user_id) ORDER BY a.user_id IS NOT NULL DESC, login_no DESC) AS rk
  FROM (SELECT * FROM (SELECT * FROM logins QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY login_no DESC) = 1)
    QUALIFY row_number() OVER (PARTITION BY email ORDER BY login_no DESC) = 1) l
  LEFT JOIN users a ON a.user_id = l.user_id LEFT JOIN users b ON b.email = l.email) WHERE rk = 1 OR old_id IS NULL""")
    out["delete_user_keys"] = sql("api_keys users", """SELECT key_id, user_id, name, key_value, created_at, last_used FROM
  (SELECT *, md5(CAST(key_id AS VARCHAR)) AS key_value FROM api_keys) WHERE user_id NOT IN (SELECT user_id FROM users WHERE plan_type = 'TEAM')""")
    out["clear_user_history"] = sql("scans", "SELECT * FROM scans WHERE user_id IS DISTINCT FROM 7")
    out["delete_scan"] = sql("scans", "SELECT * FROM scans WHERE NOT (scan_id = 33 AND (user_id IS NULL OR user_id = 7))")
    out["parsed_results"] = sql("scans issues", """SELECT i.scan_id, s.health_score AS score, severity, title, file_path, line_number FROM issues i JOIN scans s ON s.scan_id = i.scan_id""")
    out["owner_filter"] = sql("scans", """SELECT * FROM (SELECT *, CASE WHEN scan_id % 37 = 0 THEN NULL WHEN scan_id % 41 = 0 THEN '' ELSE CAST(user_id AS VARCHAR) END AS owner
  FROM scans) WHERE coalesce(owner, '') = '' OR owner = '7'""")
    out["api_key_listing"] = sql("api_keys", "SELECT user_id, key_id, name, created_at, last_used FROM api_keys")
    out["fix_progress"] = sql("issues", """
SELECT scan_id, total, coalesce(n, 0) AS fixed_count, coalesce(n, 0) * 100 // greatest(1, total) AS percent
FROM (SELECT scan_id, count(*) AS total FROM issues GROUP BY scan_id) LEFT JOIN (SELECT scan_id, count(DISTINCT (file_path, line_number)) AS n
  FROM issues WHERE severity = 'Info' GROUP BY scan_id) USING (scan_id)""")
    out["size_eta_labels"] = sql("", """
SELECT scan_id, CASE WHEN kb / 1024 >= 1024 THEN format('{:.2f} GB', round(kb / 1048576, 2)) ELSE format('{:.1f} MB', round(kb / 1024, 1)) END AS size_label,
  CASE WHEN kb * 8 / 5120 > 60 THEN CAST(floor(kb * 8 / 5120) AS BIGINT) // 60 || 'm ' || CAST(floor(kb * 8 / 5120) AS BIGINT) % 60 || 's'
    ELSE CAST(floor(kb * 8 / 5120) AS BIGINT) || 's' END AS eta_label,
  CASE WHEN ms < 1000 THEN ms || 'ms' WHEN ms < 60000 THEN format('{:.1f}s', round(ms / 1000, 1)) ELSE (ms // 60000) || 'm ' || (ms % 60000 // 1000) || 's' END AS duration_label,
  CASE WHEN age < 60 THEN 'just now' WHEN age < 3600 THEN (age // 60) || ' mins ago' WHEN age < 86400 THEN (age // 3600) || ' hours ago'
    WHEN age < 604800 THEN (age // 86400) || ' days ago' ELSE strftime(made, '%b %d, %Y') END AS age_label
FROM (SELECT o_orderkey AS scan_id, CAST(floor(o_totalprice * 7) AS BIGINT) AS kb, CAST(floor(o_totalprice * (o_orderkey % 3)) AS BIGINT) AS ms, o_orderdate AS made,
    CAST(epoch(TIMESTAMP '1998-08-02 12:00:30') - epoch(o_orderdate) AS BIGINT) AS age FROM orders)""")
    out["team_members"] = sql("teams users", """
SELECT team_name, u.user_id, u.email, CASE WHEN u.user_id = owner_id THEN 'owner' ELSE 'member' END AS role, o.email AS owner_email
FROM teams JOIN users u USING (team_id) JOIN users o ON o.user_id = owner_id""")
    out["stored_cascade_delete"] = out["cascade_delete"]
    out["stored_user_upsert"] = f"SELECT user_id, email, plan_type, last_login FROM ({out['user_upsert']})"
    return out
