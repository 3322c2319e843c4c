"""Comparison SQL: data flows, from line hits and range joins."""

from __future__ import annotations

from oracle.base import q, sql, values
from sievebase.rules import taint

NOTVAR = "('req', 'request', 'body', 'params')"


def _hits(rules: list[str]) -> str:
    return "[" + ", ".join(f"CASE WHEN regexp_matches(line, {q(p)}) THEN {i} END" for i, p in enumerate(rules)) + "]"


def _expr() -> str:
    return "CASE rule " + " ".join(f"WHEN {i} THEN regexp_extract(line, {q(p)})" for i, (p, _) in enumerate(taint.SOURCES)) + " END"


_NAMES = ", ".join(f"nullif(regexp_extract(line, {q(taint.FUNCTION)}, {i}), '')" for i in range(1, 6))
CTES = {
    "src": f"""SELECT *, coalesce(list_filter(list_transform(regexp_split_to_array(expr, '[.\\[\\] ()]'), lambda p: trim(p, '''" ' || chr(9))),
    lambda p: length(p) > 1 AND p NOT IN {NOTVAR})[-1], '') AS var FROM (
  SELECT repo, file_path, line_number, rule, {_expr()} AS expr FROM (
    SELECT repo, file_path, line_number, line, unnest(list_filter({_hits([p for p, _ in taint.SOURCES])}, lambda x: x IS NOT NULL)) AS rule FROM lines))""",
    "snk": f"""SELECT repo, file_path, line_number, rule, kind, weakness, line FROM (
    SELECT repo, file_path, line_number, line, unnest(list_filter({_hits([p for p, _, _ in taint.SINKS])}, lambda x: x IS NOT NULL)) AS rule FROM lines)
  JOIN {values([(i, k, w) for i, (_, k, w) in enumerate(taint.SINKS)], 't(rule, kind, weakness)')} USING (rule)""",
    "san": f"SELECT repo, file_path, line_number FROM lines WHERE regexp_matches(line, {q(taint.SANITIZER)})",
    "fun": f"""SELECT repo, file_path, line_number, coalesce({_NAMES}, 'anonymous') AS name FROM lines WHERE regexp_matches(line, {q(taint.FUNCTION)})
  UNION SELECT repo, file_path, 0, regexp_extract(line, {q(taint.EXPORTED_NAME)}, 1) FROM lines
  WHERE regexp_matches(line, {q(taint.EXPORT)}) AND regexp_matches(line, {q(taint.EXPORTED_NAME)})""",
}


def unchecked(table: str, first: str, last: str) -> str:
    return (
        f"NOT EXISTS (SELECT 1 FROM san z WHERE z.repo = {table}.repo AND z.file_path = {table}.file_path"
        f" AND z.line_number >= {first} AND z.line_number < {last})"
    )


def fields(line: str, title: str, effort: str, score: str) -> str:
    return (
        f"repo, file_path, {line} AS line_number, 'Critical' AS severity, 'Security' AS category, {title} AS title,"
        f" {q(effort)} AS effort_level, {score} AS confidence_score"
    )


CTES["pairs"] = f"""SELECT s.repo, s.file_path, s.line_number AS s_line, s.expr, s.var, k.line_number AS k_line, k.kind, k.weakness
  FROM (SELECT *, row_number() OVER (PARTITION BY repo, file_path, line_number ORDER BY rule) AS rn FROM src) s
  JOIN (SELECT *, row_number() OVER (PARTITION BY repo, file_path, line_number ORDER BY rule) AS rn FROM snk) k
    ON k.repo = s.repo AND k.file_path = s.file_path AND k.line_number > s.line_number
  WHERE s.rn = 1 AND k.rn = 1 AND {unchecked('s', 's.line_number', 'k.line_number')}"""
CTES["local_flows"] = f"""SELECT {fields('s_line', "'Proven ' || weakness || CASE WHEN via_call THEN ' — Taint Propagated Through Function Call' ELSE ' — Unsanitized Data Flow' END", 'Medium', 'CASE WHEN via_call THEN 92 ELSE 85 END')},
  k_line AS sink_line, via_call, expr || ' (' || file_path || ':' || s_line || ') -> ' || CASE WHEN via_call THEN name || '() (' || file_path || ':' || c_line || ') -> ' ELSE '' END
    || kind || ' (' || file_path || ':' || k_line || ')' AS data_flow_trace
  FROM (SELECT p.*, c.c.line IS NOT NULL AS via_call, c.c.line AS c_line, c.c.name AS name FROM pairs p LEFT JOIN (
    SELECT p.repo, p.file_path, p.s_line, p.k_line, min({{'line': l.line_number, 'name': f.name}}) AS c
    FROM pairs p JOIN lines l ON l.repo = p.repo AND l.file_path = p.file_path AND l.line_number > p.s_line AND l.line_number <= p.k_line
      AND regexp_matches(l.line, '\\S') AND contains(l.line, p.var)
    JOIN fun f ON f.repo = p.repo AND f.file_path = p.file_path AND contains(l.line, f.name)
    GROUP BY ALL) c USING (repo, file_path, s_line, k_line))"""
CTES["cross_flows"] = f"""SELECT {fields('s_line', "'Cross-File ' || c.weakness || ' — Taint via Function Export'", 'Hard', '75')},
  target_file, sink_line, c.name AS function_name, c.expr || ' (' || file_path || ':' || s_line || ') -> ' || c.name || '() (' || target_file || ':' || c.def_line
    || ') -> ' || c.kind || ' (' || target_file || ':' || sink_line || ')' AS data_flow_trace FROM (
  SELECT s.repo, s.file_path, s.line_number AS s_line, f.file_path AS target_file, f.sink_line,
    min({{'rule': s.rule, 'call_line': l.line_number, 'name': f.name, 'def_line': f.def_line, 'sink_rule': f.rule, 'expr': s.expr, 'kind': f.kind, 'weakness': f.weakness}}) AS c
  FROM src s JOIN lines l ON l.repo = s.repo AND l.file_path = s.file_path AND l.line_number > s.line_number AND l.line_number <= s.line_number + 50
    AND regexp_matches(l.line, '\\S') AND contains(l.line, s.var)
  JOIN (SELECT f.repo, f.file_path, f.line_number AS def_line, f.name, k.line_number AS sink_line, k.rule, k.kind, k.weakness
    FROM fun f JOIN snk k ON k.repo = f.repo AND k.file_path = f.file_path AND k.line_number > f.line_number
    WHERE {unchecked('f', 'f.line_number', 'k.line_number')}) f
    ON f.repo = s.repo AND f.file_path <> s.file_path AND contains(l.line, f.name)
  GROUP BY s.repo, s.file_path, s.line_number, f.file_path, f.sink_line)"""
CTES["property_flows"] = f"""SELECT {fields('c.s_line', "'Property Taint ' || c.weakness", 'Medium', '80')}, property, sink_line,
  c.expr || ' (' || file_path || ':' || c.s_line || ') -> ' || property || ' (' || file_path || ':' || c.at || ') -> ' || c.kind || ' (' || file_path || ':' || sink_line || ')' AS data_flow_trace
  FROM (SELECT s.repo, s.file_path, s.property, k.line_number AS sink_line,
    min({{'s_line': s.line_number, 'rule': s.rule, 'at': s.at, 'sink_rule': k.rule, 'expr': s.expr, 'kind': k.kind, 'weakness': k.weakness}}) AS c
  FROM (SELECT s.*, l.line_number AS at, regexp_extract(l.line, '(\\w+\\.\\w+)\\s*=\\s*' || regexp_escape(s.var), 1) AS property
    FROM src s JOIN lines l ON l.repo = s.repo AND l.file_path = s.file_path AND l.line_number > s.line_number AND l.line_number <= s.line_number + 30) s
  JOIN snk k ON k.repo = s.repo AND k.file_path = s.file_path AND k.line_number >= s.at AND contains(k.line, s.property)
  WHERE s.property <> '' AND {unchecked('s', 's.at', 'k.line_number')}
  GROUP BY s.repo, s.file_path, s.property, k.line_number)"""


def statements() -> dict[str, str]:
    labels = values([(i, l) for i, (_, l) in enumerate(taint.SOURCES)], "t(rule, label)")
    out: dict[str, str] = {}
    out["taint_sources"] = sql("lines", f"SELECT repo, file_path, line_number, rule, expr, label, var FROM src JOIN {labels} USING (rule)", **CTES)
    out["taint_sinks"] = sql("lines", "SELECT repo, file_path, line_number, rule, kind, weakness FROM snk", **CTES)
    out["sanitizer_lines"] = sql("lines", "SELECT * FROM san", **CTES)
    out["function_index"] = sql("lines", "SELECT * FROM fun", **CTES)
    out["intra_file_flows"] = sql("lines", "SELECT * FROM local_flows", **CTES)
    out["flows_via_local_call"] = sql("lines", "SELECT * FROM local_flows WHERE via_call", **CTES)
    out["cross_file_flows_substring"] = sql("lines", "SELECT * FROM cross_flows", **CTES)
    by_name = CTES["cross_flows"].replace("contains(l.line, f.name)", "list_contains(regexp_extract_all(l.line, '\\w+'), f.name)")
    out["cross_file_flows"] = sql("lines", "SELECT * FROM cross_flows", **{**CTES, "cross_flows": by_name})
    out["property_taint"] = sql("lines", "SELECT * FROM property_flows", **CTES)
    return out
