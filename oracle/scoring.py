"""Comparison SQL: merging, scoring and marts."""

from __future__ import annotations

from oracle import corpus, dataflow, dependencies, forensics, hygiene, performance, quality
from oracle.base import q, sql
from sievebase.rules import confidence as rules

REACH = {
    "dangling_blob_secrets": "DanglingBlob", "unreachable_sensitive_commits": "UnreachableCommit",
    "reflog_sensitive_messages": "ReflogEntry", "stash_secrets": "Stash", "history_secret_scan": "History",
    "git_config_exposure": "Active", "hook_forensics": "Active", "submodule_risks": "Active", "large_pack_objects": "Active",
}
WITH_COMMIT = {"dangling_blob_secrets", "reflog_sensitive_messages", "stash_secrets", "history_secret_scan"}
FLOWS = {"intra_file_flows", "cross_file_flows", "property_taint"}
CORE = "repo, file_path, line_number, severity, category, title, effort_level, confidence_score"
PARTS = {
    "security": ["security_rule_scan"],
    "quality": """large_file_tiers method_findings nesting_depth empty_catch console_output commented_code_blocks
        static_mutable_state bool_param_trap local_time_usage task_blocking thread_sleep long_param_list
        duplicate_blocks circular_imports""".split(),
    "performance": """n_plus_one concat_in_loop linq_in_loop sync_blocking_perf thread_sleep_perf large_allocation
        materialize_then_filter count_gt_zero undisposed_resource boxing_collections split_without_options file_read_in_loop""".split(),
    "dependency": """missing_lockfile duplicate_json_keys wildcard_versions vulnerable_npm vulnerable_python
        vulnerable_dotnet unpinned_other""".split(),
    "structure": """merge_markers missing_shebang todo_first_per_file workflow_checks repo_presence_checks env_files
        deep_paths ineffective_gitignore committed_artifacts""".split(),
    "api": ["unprotected_endpoints", "unvalidated_endpoints", "unlimited_mutations"],
    "flows": sorted(FLOWS),
    "tokens": ["high_entropy_tokens"],
    "git": sorted(REACH),
}


def merged(*groups: str) -> str:
    """Union of the statements of the analyzers, each with its own views."""
    known: dict[str, str] = {}
    for part in (corpus, quality, performance, dependencies, hygiene, dataflow, forensics):
        known.update(part.statements())
    out = []
    for name in [n for g in groups for n in PARTS[g]]:
        commit = "commit_hash" if name in WITH_COMMIT else "NULL::VARCHAR"
        date = "commit_date" if name == "reflog_sensitive_messages" else "NULL::VARCHAR"
        reach = q(REACH[name]) if name in REACH else "NULL::VARCHAR"
        out.append(
            f"SELECT {CORE}, {'true' if name in FLOWS else 'false'} AS has_flow, {commit} AS commit_hash, {date} AS commit_date,"
            f" {reach} AS reachability_status FROM ({known[name]})"
        )
    return " UNION ALL ".join(out)


# Analyzers whose findings are those of other statements than the one with their name.
MADE_OF = {
    "rule_findings": ["security_rule_scan"], "entropy_findings": ["high_entropy_tokens"],
    "loop_findings": ["n_plus_one", "concat_in_loop", "linq_in_loop"],
    "endpoint_findings": ["unprotected_endpoints", "unvalidated_endpoints", "unlimited_mutations"],
}


def status() -> str:
    """A row per analyzer with its number of findings."""
    known: dict[str, str] = {}
    for part in (corpus, quality, performance, dependencies, hygiene, dataflow, forensics):
        known.update(part.statements())
    inside = {name for names in MADE_OF.values() for name in names}
    alone = [n for group in PARTS.values() for n in group if n not in inside]
    # The corpus has no binary or oversize file.
    rows = [(n, [n]) for n in alone] + list(MADE_OF.items()) + [("oversize_and_binary", [])]
    count = lambda names: " + ".join(["0", *(f"(SELECT count(*) FROM ({known[n]}))" for n in names)])
    return " UNION ALL ".join(
        f"SELECT {q(name)} AS analyzer, NULL::VARCHAR AS repo, 'ok' AS status, NULL::VARCHAR AS error, {count(names)} AS findings" for name, names in rows
    )


EXT = r"lower(regexp_extract(file_path, '(\.[^./]+)$', 1))"


def _inlist(types: list[str]) -> str:
    return "(" + ", ".join(q(t) for t in types) + ")"


_CONTEXT = " ".join(
    f"WHEN contains(lower(title), {q(w.lower())}) THEN {EXT} IN {_inlist(types)}" for w, types in rules.CONTEXTS
)
_STARTS = r"""(//|#|--|/\*|'''|\"\"\"|;)"""


def scored(source: str) -> str:
    """Scored findings: confidence for score 0, severity lowered below 40."""
    return f"""
SELECT repo, file_path, line_number, CASE WHEN unscored AND points < 40 THEN 'Info' ELSE severity END AS severity, category, title,
  effort_level, CASE WHEN unscored THEN points ELSE confidence_score END AS confidence_score, has_flow, commit_hash, commit_date, reachability_status
FROM (SELECT *, confidence_score = 0 AS unscored,
    CASE WHEN line IS NULL OR NOT (regexp_matches(trimmed, {q('^' + _STARTS)}) OR regexp_matches(trimmed_left, '^(\\* |REM )')
        OR regexp_matches(trimmed_left, {q(rules.LOG_CALL)})) THEN 40 ELSE 0 END
    + CASE WHEN many THEN 20 ELSE 0 END
    + CASE WHEN line IS NULL OR NOT (trimmed = '' OR regexp_matches(trimmed, {q('^' + _STARTS)}) OR regexp_matches(trimmed, '^(\\* |REM )')
        OR coalesce(in_block, false)) THEN 20 ELSE 0 END
    + CASE WHEN fits THEN 20 ELSE 0 END AS points
  FROM (SELECT f.*, l.line, regexp_replace(l.line, '^\\s+', '') AS trimmed_left, regexp_replace(l.line, '^\\s+|\\s+$', '', 'g') AS trimmed,
      l.in_block, count(DISTINCT f.file_path) OVER (PARTITION BY f.repo, lower(f.title)) > 1 AS many,
      CASE WHEN {EXT.replace('file_path', 'f.file_path')} = '' THEN true {_CONTEXT.replace('file_path', 'f.file_path')}
        ELSE {EXT.replace('file_path', 'f.file_path')} IN {_inlist(rules.CODE_TYPES)} END AS fits
    FROM {source} f LEFT JOIN (
      SELECT repo, file_path, line_number, line, last_value(CASE WHEN contains(line, '/*') OR contains(line, '*/')
          THEN contains(line, '/*') AND NOT contains(line, '*/') END IGNORE NULLS) OVER (PARTITION BY repo, file_path
          ORDER BY line_number ROWS BETWEEN 49 PRECEDING AND 1 PRECEDING) AS in_block FROM lines) l
    ON l.repo = f.repo AND l.file_path = f.file_path AND l.line_number = f.line_number))"""


HEALTH = """least(100, greatest(5, 100 - least(40, 10 * c) - least(30, 3 * w) - least(10, i) + CASE WHEN t1 THEN 0 ELSE 5 END
  + CASE WHEN t2 THEN 0 ELSE 3 END + CASE WHEN t3 THEN 0 ELSE 2 END + CASE WHEN t4 THEN 0 ELSE 2 END + CASE WHEN t5 THEN 0 ELSE 5 END))"""
COUNTS = """count(*) FILTER (severity = 'Critical') AS c, count(*) FILTER (severity = 'Warning') AS w, count(*) FILTER (severity = 'Info') AS i"""
FLAGS = """bool_or(title = 'No Tests Detected') AS t1, bool_or(title = 'No CI/CD Configuration') AS t2, bool_or(title = 'No README Found') AS t3,
  bool_or(title = 'No .gitignore File') AS t4, bool_or(contains(title, 'Hardcoded') AND severity = 'Critical') AS t5"""
HEAD = {"g": f"SELECT repo, {COUNTS}, {FLAGS} FROM m GROUP BY repo"}


BLAME_DATE = "strftime(make_timestamp(author_time * 1000000), '%Y-%m-%d %H:%M UTC')"
BLAMED = f"""
SELECT m.* EXCLUDE (commit_hash, commit_date), coalesce(b.hash, m.commit_hash) AS commit_hash, author, author_email, summary AS commit_message,
  coalesce({BLAME_DATE}, m.commit_date) AS commit_date, author || ' in ' || substr(b.hash, 1, 7) || ' (' || {BLAME_DATE} || ')' AS introduced_by
FROM m1 m LEFT JOIN line_blame b ON b.repo = m.repo AND b.file_path = m.file_path AND b.line_number = m.line_number
  AND m.line_number > 0 AND m.file_path <> '' AND NOT starts_with(m.file_path, '.git/')"""
CHAINED = """
SELECT * EXCLUDE (up, flow, chained, rk) REPLACE (CASE WHEN up OR flow THEN 'Critical' ELSE severity END AS severity,
  least(100, confidence_score + CASE WHEN up THEN 15 WHEN flow THEN 10 ELSE 0 END) AS confidence_score,
  CASE WHEN regexp_matches(title, 'Hardcoded|Secret') AND coalesce(reachability_status, '') = '' THEN 'Active' ELSE reachability_status END AS reachability_status)
FROM (SELECT *, title = 'Unprotected API Endpoint' AND rk = 1 AND chained AS up, has_flow AND severity = 'Warning' AS flow FROM (
  SELECT *, bool_or(title = 'No Input Validation on Endpoint') OVER (PARTITION BY repo, file_path) AS chained,
    row_number() OVER (PARTITION BY repo, file_path, title ORDER BY line_number) AS rk FROM m2))"""
PLAN = """
SELECT scan_id, rule_name, instance_count, file_count, round_even(hours, 2) AS estimated_hours, score_impact,
  CAST(hours * 85 AS DOUBLE) AS dollar_cost, fix_confidence, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY score_impact DESC, rule_name) AS rank FROM (
    SELECT *, round_even((c * 10.0 + w * 3.0) / ln(hours + 1.1), 2) AS score_impact,
      greatest(40, least(97, 80 + CASE WHEN instance_count < 5 THEN 10 ELSE 0 END - CASE WHEN file_count > 10 THEN 15 ELSE 0 END
        + CASE WHEN i > c AND i > w THEN 5 WHEN c > 0 THEN -10 ELSE 0 END)) AS fix_confidence
    FROM (SELECT scan_id, title AS rule_name, count(*) AS instance_count, count(DISTINCT file_path) AS file_count,
        CAST(sum(CASE WHEN effort_level = 'Medium' THEN 2.0 WHEN severity = 'Critical' THEN 4.0 WHEN severity = 'Warning' THEN 1.5 ELSE 0.5 END) AS DOUBLE) AS hours,
        count(*) FILTER (severity = 'Critical') AS c, count(*) FILTER (severity = 'Warning') AS w, count(*) FILTER (severity = 'Info') AS i
      FROM issues GROUP BY scan_id, title))) WHERE rank <= 5"""


def statements() -> dict[str, str]:
    out: dict[str, str] = {}
    everything = tuple(PARTS)
    out["merge_analyzers"] = sql("", f"SELECT {CORE}, reachability_status FROM m", m=merged(*everything))
    out["scan_status"] = status()
    out["confidence_score"] = sql("lines", f"SELECT {CORE} FROM s", m=merged(*everything), s=scored("m"))
    full = {"m0": merged(*everything), "m1": scored("m0"), "m2": BLAMED, "m": CHAINED}
    views = "lines line_blame"
    out["full_scan"] = sql(views, f"SELECT {CORE}, reachability_status, commit_hash, introduced_by FROM m", **full)
    out["blame_attribution"] = sql(views, f"""
SELECT {CORE}, commit_hash, author, author_email, commit_message, commit_date, introduced_by FROM m""", **full)
    out["attack_chains"] = sql(views, f"SELECT {CORE}, reachability_status FROM m", **full)
    out["health_score"] = sql(views, f"SELECT repo, c AS critical, w AS warning, i AS info, {HEALTH} AS health_score FROM g", **full, **HEAD)
    debt = "c * 4.0 + w * 1.5 + i * 0.5"
    out["tech_debt"] = sql("issues", f"""SELECT scan_id, CAST({debt} AS DOUBLE) AS hours, CAST(({debt}) * 85 AS DOUBLE) AS dollars,
  CAST(ceil({debt}) AS BIGINT) AS hours_saved FROM (SELECT scan_id, {COUNTS} FROM issues GROUP BY scan_id)""")
    out["file_risk"] = sql(views, f"""SELECT repo, file_path, c AS critical, w AS warning, i AS info, 10 * c + 3 * w + i AS risk_score,
  CASE WHEN 10 * c + 3 * w + i >= 30 THEN 'CRITICAL' WHEN 10 * c + 3 * w + i >= 10 THEN 'WARNING' ELSE 'LOW' END AS risk_tier
FROM (SELECT repo, file_path, {COUNTS} FROM m GROUP BY repo, file_path)""", **full)
    out["distinct_critical_titles"] = sql(views, "SELECT DISTINCT repo, title FROM m WHERE category = 'Security' AND severity = 'Critical'", **full)
    out["action_plan"] = sql("issues", PLAN)
    out["confidence_bands"] = sql("issues", """SELECT CASE WHEN confidence_score >= 80 THEN 'HIGH' WHEN confidence_score >= 50 THEN 'MEDIUM'
  ELSE 'LOW' END AS band, count(*) AS findings FROM issues GROUP BY 1""")
    out["action_plan_files"] = sql("issues", """SELECT DISTINCT i.scan_id, i.title AS rule_name, i.file_path FROM issues i
JOIN plan p ON p.scan_id = i.scan_id AND p.rule_name = i.title""", plan=PLAN)
    out["analysis_summary"] = sql("kept lines line_blame", f"""
SELECT g.repo, {HEALTH} AS health_score, concat_ws(' ', files || ' files with ' || format('{{:,}}', n_lines) || ' lines.',
  CASE WHEN c > 0 THEN c || ' critical, first ' || f.first.title || ' in ' || f.first.file_path || '.' END,
  CASE WHEN w > 0 THEN w || ' warnings, most in ' || worst || '.' END, CASE WHEN i > 0 THEN i || ' notes.' END,
  CASE WHEN history > 0 THEN history || ' secrets in history.' END, CASE WHEN lost > 0 THEN lost || ' in lost objects.' END,
  CASE WHEN flows > 0 THEN flows || ' proven flows.' END, CASE WHEN api > 0 THEN api || ' on endpoints.' END,
  sure || ' of high confidence.', CASE WHEN attributed > 0 THEN attributed || ' attributed.' END,
  'Debt ' || CAST(round({debt}) AS BIGINT) || 'h. ' || CASE WHEN {HEALTH} >= 80 THEN 'Healthy' WHEN {HEALTH} >= 50 THEN 'Needs Attention'
    ELSE 'Critical' END || ' (' || {HEALTH} || '/100).') AS summary
FROM g JOIN (SELECT repo, count(*) AS files, CAST(sum(len(string_split(content, chr(10)))) AS BIGINT) AS n_lines FROM kept GROUP BY repo) USING (repo)
JOIN (SELECT repo, min(CASE WHEN severity = 'Critical' THEN {{'file_path': file_path, 'line_number': line_number, 'title': title}} END) AS first,
    count(*) FILTER (contains(title, 'Git History')) AS history, count(*) FILTER (reachability_status IN ('DanglingBlob', 'UnreachableCommit')) AS lost,
    count(*) FILTER (has_flow) AS flows, count(*) FILTER (category = 'ApiSurface') AS api, count(*) FILTER (confidence_score >= 80) AS sure,
    count(*) FILTER (coalesce(commit_hash, '') <> '') AS attributed FROM m GROUP BY repo) f USING (repo)
LEFT JOIN (SELECT repo, arg_min(file_path, (-n, file_path)) AS worst FROM (SELECT repo, file_path, count(*) AS n FROM m
    WHERE severity = 'Warning' GROUP BY repo, file_path) GROUP BY repo) USING (repo)""", **full, **HEAD)
    return out
