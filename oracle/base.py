"""Shared views of the comparison SQL, written as common table expressions."""

from __future__ import annotations

from sievebase.sources.tables import SNIPPET_PERIOD, SNIPPETS

NL = "chr(10)"


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


_VALUES = ",\n".join(f"({i}, {q(ext)}, {q(body)})" for i, ext, body in SNIPPETS)

SKIP_DIR_RX = (
    r"(^|/)(node_modules|\.git|bin|obj|dist|build|\.vs|packages|vendor|__pycache__|\.next|\.nuxt"
    r"|coverage|\.terraform|migrations|\.idea|\.vscode|bower_components|\.cache|\.parcel-cache|target)/"
)
SKIP_EXT_RX = (
    r"\.(png|jpg|jpeg|gif|svg|ico|pdf|exe|dll|zip|tar|gz|rar|7z|lock|map|woff|woff2|ttf|eot|otf|bmp|webp"
    r"|mp3|mp4|avi|mov|so|dylib|o|a|lib|pdb|class|jar|war|ear|pyc|pyo|ds_store|suo)$"
)

VIEWS: dict[str, str] = {
    "snippets": f"SELECT * FROM (VALUES\n{_VALUES}) t(snip_id, ext, body)",
    "code_corpus": f"""
SELECT d.doc_id, d.source AS repo,
  CASE
    WHEN snip_id = 9 THEN d.lang || '/d' || d.doc_id || '/package.json'
    WHEN snip_id = 10 THEN d.lang || '/d' || d.doc_id || '/requirements.txt'
    WHEN snip_id = 18 THEN '.github/workflows/w' || d.doc_id || '.yml'
    WHEN snip_id = 20 THEN 'r' || d.doc_id || '/.git/config'
    WHEN snip_id = 21 THEN 'r' || d.doc_id || '/.gitmodules'
    WHEN snip_id = 22 THEN 'r' || d.doc_id || '/.git/hooks/on-login'
    WHEN snip_id = 23 THEN 'r' || d.doc_id || '/.env'
    WHEN snip_id IN (24, 25) THEN 'r' || d.doc_id || '/.gitignore'
    WHEN snip_id = 26 THEN 'r' || d.doc_id || '/logs/run.log'
    WHEN snip_id = 29 THEN 'r' || d.doc_id || '/Gemfile'
    WHEN snip_id = 30 THEN 'r' || d.doc_id || '/go.mod'
    WHEN snip_id = 31 THEN 'r' || d.doc_id || '/pom.xml'
    WHEN snip_id = 35 THEN 'src/Ring.Alpha' || d.doc_id || '.cs'
    WHEN snip_id = 36 THEN 'src/Ring.Beta' || d.doc_id || '.cs'
    WHEN snip_id = 38 THEN 'a/b/c/d/e/f' || d.doc_id || '/page.js'
    WHEN snip_id = 39 THEN 'test/t' || d.doc_id || '.cs'
    ELSE d.lang || '/f' || d.doc_id || COALESCE(ext, '.md') END AS file_path,
  CASE WHEN body IS NULL THEN d.text
       WHEN snip_id = 28 THEN replace(body, '~', chr(10)) || chr(10) || d.text
       ELSE d.text || chr(10) || replace(body, '~', chr(10)) END AS content
FROM documents d LEFT JOIN snippets s ON (d.doc_id + d.doc_id // 20) % {SNIPPET_PERIOD} = s.snip_id""",
    "file_listing": """
SELECT repo, CASE doc_id % 11 WHEN 0 THEN 'node_modules/' || file_path WHEN 1 THEN 'a/Build/' || file_path
   WHEN 2 THEN file_path || '.min.js' WHEN 3 THEN file_path || '.PNG'
   WHEN 4 THEN 'tools/t' || doc_id || '.exe' WHEN 5 THEN 'lib/l' || doc_id || '.dll'
   WHEN 6 THEN 'svc/s' || doc_id || '/Dockerfile.prod' WHEN 7 THEN 'svc/s' || doc_id || '/Makefile'
   ELSE file_path END AS file_path, content,
   CAST(strlen(content) * (1 + doc_id % 64) AS BIGINT) AS size_bytes
FROM code_corpus""",
    "kept": f"""
SELECT * FROM code_corpus
WHERE NOT regexp_matches(lower(file_path), {q(SKIP_DIR_RX)})
  AND NOT regexp_matches(lower(file_path), {q(SKIP_EXT_RX)})
  AND NOT regexp_matches(lower(file_path), '\\.min\\.(js|css)$')""",
    "lines": """
SELECT repo, file_path, unnest(string_split(content, chr(10))) AS line,
  CAST(unnest(range(1, len(string_split(content, chr(10))) + 1)) AS INT) AS line_number
FROM kept""",
    "repo_urls": """
SELECT page_id, CASE page_id % 12
  WHEN 0 THEN 'https://github.com/acme' || rest WHEN 1 THEN 'https://GitLab.com/team/app.git/tree/main' || rest
  WHEN 2 THEN '  http://bitbucket.org/o/r.git/ ' WHEN 3 THEN 'https://bob:pw@github.com/o' || rest
  WHEN 4 THEN 'ssh://git@github.com/o' || rest WHEN 5 THEN 'http://10.0.0.8' || rest
  WHEN 6 THEN 'http://localhost:8080' || rest WHEN 7 THEN 'https://github.com/onlyowner' WHEN 8 THEN ''
  WHEN 9 THEN 'https://dev.azure.com/org/proj/blob/x' || rest ELSE url END AS url
FROM (SELECT page_id, url, regexp_replace(url, '^https?://[^/]+', '') AS rest FROM pages)""",
    "scans": """
SELECT o_orderkey AS scan_id, o_custkey AS user_id,
  CASE WHEN o_orderkey % 50 = 0 THEN '' ELSE 'repo_' || (o_custkey % 97) END AS repository_name,
  CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'ANALYSIS' ELSE 'FAILED' END AS status,
  o_orderdate AS created_at, CASE WHEN o_orderkey % 41 <> 0 THEN CAST(o_orderkey % 96 + 5 AS INT) END AS health_score
FROM orders""",
    "scan_requests": """
SELECT o_orderkey AS scan_id, o_custkey - o_custkey % 4 AS user_id,
  make_timestamp((1704067200 + o_orderkey * 7919 % 120 * 86400 + o_orderkey % 24 * 3600) * 1000000) AS created_at, o_orderkey % 6 = 0 AS is_private
FROM orders""",
    "quota_users": """
SELECT c_custkey AS user_id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'PRO' ELSE 'FREE' END AS plan_type,
  CASE WHEN c_custkey % 3 <> 0 THEN make_timestamp((1704067200 + c_custkey % 40 * 86400) * 1000000) END AS reset_date,
  CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 5 END AS scans_this_month FROM customer""",
    # One request after the other: the count and the reset date that each finds and leaves.
    "quota_lines": """
SELECT r.*, u.plan_type, u.reset_date, coalesce(u.scans_this_month, 0) AS stored, row_number() OVER (PARTITION BY user_id ORDER BY created_at, scan_id) AS n
FROM scan_requests r JOIN quota_users u USING (user_id)""",
    "quota_walk": """
SELECT user_id, 0::BIGINT AS n, NULL::BIGINT AS scan_id, any_value(plan_type) AS plan_type, any_value(reset_date) AS until, NULL::TIMESTAMP AS start,
  any_value(stored)::BIGINT AS used, NULL::VARCHAR AS reason FROM quota_lines GROUP BY user_id
UNION ALL
SELECT user_id, n, scan_id, plan_type, until, start, found + CASE WHEN reason IS NULL THEN 1 ELSE 0 END, reason FROM (
  SELECT *, CASE WHEN plan_type <> 'FREE' THEN NULL WHEN found >= 3 THEN 'limit reached' WHEN is_private THEN 'private repository' END AS reason FROM (
    SELECT w.user_id, l.n, l.scan_id, l.plan_type, l.is_private,
      CASE WHEN w.until IS NULL OR w.until <= l.created_at THEN l.created_at + INTERVAL 1 MONTH ELSE w.until END AS until,
      CASE WHEN w.until IS NULL OR w.until <= l.created_at THEN l.created_at ELSE w.start END AS start,
      CASE WHEN w.until IS NULL OR w.until <= l.created_at THEN 0 ELSE w.used END AS found
    FROM quota_walk w JOIN quota_lines l ON l.user_id = w.user_id AND l.n = w.n + 1))""",
    "issues": """
SELECT l_orderkey AS scan_id,
  CASE l_returnflag WHEN 'R' THEN 'Critical' WHEN 'A' THEN 'Warning' ELSE 'Info' END AS severity,
  CASE l_partkey % 6 WHEN 0 THEN 'Security' WHEN 1 THEN 'Quality' WHEN 2 THEN 'Performance'
    WHEN 3 THEN 'Dependency' WHEN 4 THEN 'Structure' ELSE 'ApiSurface' END AS category,
  'Rule ' || (l_partkey % 60) AS title, 'src/f' || l_suppkey || '.py' AS file_path,
  CAST(l_quantity AS INT) AS line_number,
  CASE l_linenumber % 3 WHEN 0 THEN 'Easy' WHEN 1 THEN 'Medium' ELSE 'Hard' END AS effort_level,
  CAST(l_partkey % 101 AS INT) AS confidence_score,
  '=Fix rule ' || (l_partkey % 60) || chr(10) || 'then "test"' AS suggestion
FROM lineitem""",
    "users": """
SELECT c_custkey AS user_id, c_name || '@x.io' AS email, c_name AS display_name,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'PRO' WHEN 'MACHINERY' THEN 'TEAM' ELSE 'FREE' END AS plan_type,
  c_nationkey AS team_id,
  make_timestamp((1700000000 + c_custkey * 7919 % 8640000) * 1000000) AS last_login
FROM customer""",
    "api_keys": """
SELECT o_orderkey AS key_id, o_custkey AS user_id, o_orderpriority AS name, o_orderdate AS created_at,
  CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS last_used FROM orders""",
    "logins": """
SELECT CASE WHEN c_custkey % 3 = 0 THEN c_custkey ELSE c_custkey + 10000000 END AS user_id,
  c_name || CASE WHEN c_custkey % 3 = 1 THEN '@x.io' ELSE '@new.io' END AS email, c_custkey AS login_no FROM customer
UNION ALL SELECT CASE WHEN c_custkey % 3 = 0 THEN c_custkey ELSE c_custkey + 10000000 END,
  CASE WHEN c_custkey % 4 = 0 THEN 'again-' || c_name || '@new.io' WHEN c_custkey % 3 = 1 THEN c_name || '@x.io' ELSE c_name || '@new.io' END,
  c_custkey + 20000000 FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT c_custkey + 30000000, c_name || '@x.io', c_custkey + 40000000 FROM customer WHERE c_custkey % 7 = 0""",
    "advisories": """
SELECT CASE WHEN k % 12 IN (3, 4, 5) THEN 'python' WHEN k % 12 IN (6, 7) THEN 'dotnet' ELSE 'npm' END AS ecosystem,
  CASE k % 12 WHEN 0 THEN 'lodash' WHEN 1 THEN 'Axios' WHEN 2 THEN 'left-pad' WHEN 3 THEN 'django' WHEN 4 THEN 'Requests' WHEN 5 THEN 'flask'
    WHEN 6 THEN 'Newtonsoft.Json' WHEN 7 THEN 'log4net' ELSE 'part-' || k END AS package,
  CASE WHEN k % 7 <> 0 THEN concat_ws('.', k % 5, k % 20, k % 4) END AS introduced, CASE WHEN k % 9 <> 0 THEN concat_ws('.', k % 5 + k % 3, k % 23) END AS fixed,
  CASE k % 3 WHEN 0 THEN 'Critical' WHEN 1 THEN 'Warning' ELSE 'Info' END AS severity, 'SA-' || k AS advisory_id, p_name AS remark
FROM (SELECT p_partkey AS k, p_name FROM part)""",
    "teams": "SELECT n_nationkey AS team_id, n_name AS team_name, CAST(n_nationkey AS BIGINT) AS owner_id FROM nation",
    "scan_events": """
SELECT event_id, user_id AS scan_id, ts,
  CASE event_type WHEN 'signup' THEN 'CLONING' WHEN 'view' THEN 'ANALYSIS' WHEN 'click' THEN 'AI_REVIEW'
    WHEN 'purchase' THEN 'COMPLETED' ELSE 'FAILED' END AS status, value AS progress
FROM events""",
    "git_objects": """
SELECT repo, md5(CAST(doc_id AS VARCHAR)) || substr(md5('x' || doc_id), 1, 8) AS hash,
  CASE doc_id % 3 WHEN 0 THEN 'blob' WHEN 1 THEN 'commit' ELSE 'tree' END AS obj_type,
  CASE doc_id % 4 WHEN 0 THEN 'unreachable' WHEN 1 THEN 'dangling' ELSE 'reachable' END AS reach,
  CAST(length(content) * 40000 AS BIGINT) AS size_bytes, file_path AS touched_paths, content,
  1600000000 + doc_id * 3600 AS commit_time
FROM code_corpus""",
    "git_history": """
SELECT doc_id, repo, doc_id // 200 AS block, md5(CAST(doc_id AS VARCHAR)) || substr(md5('x' || doc_id), 1, 8) AS commit,
  regexp_extract(file_path, '^[^/]*') || '/h' || (doc_id // 200) || '.txt' AS file_path, content AS raw,
  row_number() OVER (PARTITION BY repo, doc_id // 200 ORDER BY doc_id) AS nth
FROM code_corpus""",
    "git_commits": """
SELECT repo, commit, list_filter([coalesce(last, CASE WHEN nth = 1 THEN before END), other], lambda x: x IS NOT NULL) AS parents,
  1600000000 + doc_id * 3600 - CASE WHEN doc_id % 11 = 0 THEN 500000 ELSE 0 END AS commit_time
FROM (SELECT repo, block, doc_id, commit, nth, lag(commit) OVER w AS last, CASE WHEN doc_id % 7 = 0 THEN lag(commit, 3) OVER w END AS other
      FROM git_history WINDOW w AS (PARTITION BY repo, block ORDER BY doc_id))
LEFT JOIN (SELECT repo, block + 1 AS block, arg_max(commit, doc_id) AS before FROM git_history GROUP BY ALL) USING (repo, block)""",
    "git_versions": """
SELECT *, lag(new_blob) OVER w AS old_blob,
  last_value(new_blob) OVER (PARTITION BY repo, block, file_path ORDER BY nth RANGE BETWEEN UNBOUNDED PRECEDING AND 3 PRECEDING) AS other_blob
FROM (SELECT *, md5(content) AS new_blob FROM (
  SELECT doc_id, repo, block, commit, nth, file_path, coalesce(lag(raw) OVER f || chr(10), '') || raw AS content,
    lag(commit) OVER l AS last, CASE WHEN doc_id % 7 = 0 THEN lag(commit, 3) OVER l END AS other
  FROM git_history WINDOW f AS (PARTITION BY repo, block, file_path ORDER BY nth), l AS (PARTITION BY repo, block ORDER BY doc_id)))
WINDOW w AS (PARTITION BY repo, block, file_path ORDER BY nth)""",
    "git_changes": """
SELECT repo, commit, last AS parent, file_path, old_blob, new_blob FROM git_versions
UNION ALL SELECT repo, commit, other, file_path, other_blob, new_blob FROM git_versions WHERE other IS NOT NULL""",
    "git_blobs": "SELECT DISTINCT repo, new_blob AS blob, content FROM git_versions",
    # A longest common subsequence row by row, on reversed lines that both versions have; then the walk back.
    "lcs_pairs": """
SELECT repo, old_blob, new_blob, string_split(n.content, chr(10)) AS lines, coalesce(string_split(o.content, chr(10)), []) AS before
FROM (SELECT DISTINCT repo, old_blob, new_blob FROM git_changes) JOIN git_blobs n USING (repo)
LEFT JOIN git_blobs o ON o.repo = n.repo AND o.blob = old_blob WHERE n.blob = new_blob""",
    "lcs_common": """
SELECT *, list_reverse(list_filter(before, lambda x: list_contains(lines, x))) AS a, list_reverse(list_transform(places, lambda k: lines[k])) AS b
FROM (SELECT *, list_filter(range(1, len(lines) + 1), lambda k: list_contains(before, lines[k])) AS places FROM lcs_pairs)""",
    "lcs_rows": """
SELECT repo, old_blob, new_blob, a, b, 0 AS i, list_transform(range(0, len(b) + 1), lambda j: 0::BIGINT) AS r FROM lcs_common WHERE a <> b
UNION ALL
SELECT repo, old_blob, new_blob, a, b, i + 1, list_transform(range(1, len(t) + 1), lambda j: list_max(t[1:j])) FROM (
  SELECT *, list_transform(range(1, len(r) + 1), lambda j: greatest(r[j], CASE WHEN j > 1 AND b[j - 1] = a[i + 1] THEN r[j - 1] + 1 ELSE 0 END)) AS t
  FROM lcs_rows WHERE i < len(a))""",
    "lcs_walk": """
SELECT repo, old_blob, new_blob, len(a) AS i, len(b) AS j, 0 AS hit FROM lcs_common WHERE a <> b
UNION ALL
SELECT w.repo, w.old_blob, w.new_blob, CASE WHEN same OR NOT flat THEN w.i - 1 ELSE w.i END, CASE WHEN same OR flat THEN w.j - 1 ELSE w.j END,
  CASE WHEN same THEN w.j ELSE 0 END
FROM (SELECT w.*, r.a[w.i] = r.b[w.j] AS same, r.r[w.j] = r.r[w.j + 1] AS flat
      FROM lcs_walk w JOIN lcs_rows r ON r.repo = w.repo AND r.old_blob = w.old_blob AND r.new_blob = w.new_blob AND r.i = w.i
      WHERE w.i > 0 AND w.j > 0) w""",
    "lcs_added": """
SELECT c.repo, c.old_blob, c.new_blob, list_filter(range(1, len(lines) + 1), lambda k: NOT list_contains(
  CASE WHEN a = b THEN places ELSE coalesce(kept, []) END, k)) AS added
FROM lcs_common c LEFT JOIN (
  SELECT w.repo, w.old_blob, w.new_blob, list(places[len(b) - hit + 1]) AS kept FROM lcs_walk w JOIN lcs_common c
    ON c.repo = w.repo AND c.old_blob = w.old_blob AND c.new_blob = w.new_blob WHERE hit > 0 GROUP BY ALL) k
  ON k.repo = c.repo AND k.old_blob = c.old_blob AND k.new_blob = c.new_blob""",
    "added": """
SELECT x.repo, x.commit, x.file_path, x.new_blob AS blob, n FROM (
  SELECT g.repo, g.commit, g.file_path, g.new_blob, count(DISTINCT coalesce(parent, '')) AS rows_, list(d.added) AS lists
  FROM (SELECT DISTINCT * FROM git_changes) g JOIN lcs_added d
    ON d.repo = g.repo AND d.new_blob = g.new_blob AND d.old_blob IS NOT DISTINCT FROM g.old_blob GROUP BY ALL) x
JOIN git_commits c ON c.repo = x.repo AND c.commit = x.commit
CROSS JOIN LATERAL (SELECT unnest(list_reduce(lists, lambda p, q: list_intersect(p, q))) AS n)
WHERE rows_ >= greatest(len(list_distinct(parents)), 1)""",
    "dates": """
SELECT repo, commit, max(v) AS date FROM commit_values GROUP BY ALL""",
    "commit_values": """
SELECT repo, commit, commit_time AS v FROM git_commits
UNION SELECT c.repo, c.commit, p.v + 1 FROM commit_values p JOIN git_commits c ON c.repo = p.repo AND list_contains(c.parents, p.commit)
WHERE p.v + 1 > c.commit_time""",
    "reflog": """
SELECT 'src' || (user_id % 20) AS repo, md5(CAST(event_id % 4000 AS VARCHAR)) || '00000000' AS hash,
  'HEAD@{' || event_id || '}' AS entry, event_type AS action, ts,
  CASE event_type WHEN 'error' THEN 'Remove Password from config' WHEN 'click' THEN 'rotate api key'
    ELSE 'update docs' END AS message
FROM events""",
    "stashes": """
SELECT repo, hash, 'stash@{' || substr(hash, 1, 2) || '}' AS ref_name,
  CASE WHEN substr(hash, 1, 1) < '4' THEN 'WIP: secret test' ELSE 'WIP' END AS message, content AS diff
FROM git_objects WHERE obj_type = 'tree'""",
    "line_blame": """
SELECT repo, file_path, CAST(n + 1 AS INT) AS line_number,
  md5(file_path || (n % 5)) || '00000000' AS hash, 'dev' || (n % 7) AS author,
  'dev' || (n % 7) || '@x.io' AS author_email, 1700000000 + n * 3600 AS author_time,
  'commit subject' AS summary
FROM (SELECT repo, file_path, unnest(range(len(string_split(content, chr(10))))) AS n FROM code_corpus)""",
}
NEEDS = {
    "code_corpus": ["snippets"], "file_listing": ["code_corpus"], "kept": ["code_corpus"],
    "lines": ["kept"], "git_objects": ["code_corpus"], "stashes": ["git_objects"],
    "line_blame": ["code_corpus"], "git_history": ["code_corpus"], "git_commits": ["git_history"], "git_versions": ["git_history"],
    "git_changes": ["git_versions"], "git_blobs": ["git_versions"], "lcs_pairs": ["git_changes", "git_blobs"], "lcs_common": ["lcs_pairs"],
    "lcs_rows": ["lcs_common"], "lcs_walk": ["lcs_rows"], "lcs_added": ["lcs_walk"], "added": ["lcs_added", "git_commits"],
    "quota_lines": ["scan_requests", "quota_users"], "quota_walk": ["quota_lines"],
    "commit_values": ["git_commits"], "dates": ["commit_values"],
}
# Views used more than once are computed once.
MATERIALIZED = {"code_corpus", "kept", "lines", "git_history", "git_versions", "git_commits", "lcs_common", "lcs_rows", "lcs_added", "added"}


def _closure(names: list[str], seen: list[str]) -> list[str]:
    for name in names:
        _closure(NEEDS.get(name, []), seen)
        if name not in seen:
            seen.append(name)
    return seen


def sql(views: str, body: str, **ctes: str) -> str:
    """``body`` over the named views and extra common table expressions."""
    parts = []
    for name in _closure(views.split(), []):
        kind = "MATERIALIZED " if name in MATERIALIZED else ""
        parts.append(f"{name} AS {kind}({VIEWS[name]})")
    parts += [f"{name} AS ({text})" for name, text in ctes.items()]
    return f"WITH RECURSIVE {', '.join(parts)}\n{body}" if parts else body


def rule_array(line: str, rules: list[tuple[int, str]], flags: str = "i") -> str:
    """List of the numbers of the rules whose pattern matches ``line``."""
    opts = f", {q(flags)}" if flags else ""
    return "[" + ", ".join(
        f"CASE WHEN regexp_matches({line}, {q(p)}{opts}) THEN {i} END" for i, p in rules
    ) + "]"


def values(rows: list[tuple], names: str) -> str:
    def lit(v):
        return q(v) if isinstance(v, str) else "NULL" if v is None else str(v)

    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) {names}"
