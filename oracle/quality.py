"""Comparison SQL: code quality."""

from __future__ import annotations

from oracle.base import q, sql
from oracle.corpus import EXT, NAME
from sievebase.operators.quality import BRANCH, EMPTY_CATCH, METHOD

MARK = "chr(1)"
STATIC = (
    r"(private|protected|internal)\s+((static|readonly)\s+)?"
    r"(List|Dictionary|Hashtable|Array|Queue|Stack|Set)\b"
)
SIG = r"(public|private|protected|internal)\s+\w[\w<>\[\],\s]*\s\w+\s*\("


def core(line: str, severity: str, category: str, title: str, effort: str = "Easy", score: int = 0) -> str:
    """The finding columns every query shares."""
    return (
        f"repo, file_path, CAST({line} AS INT) AS line_number, {q(severity)} AS severity, {q(category)} AS category,"
        f" {q(title)} AS title, {q(effort)} AS effort_level, {score} AS confidence_score"
    )


def content_matches(pattern: str, cols: str) -> str:
    """One row per match of a multi-line pattern; ``n`` is its line."""
    return f"""
SELECT {cols} FROM (
  SELECT repo, file_path, n, unnest(range(1, CAST(len(l) - len(replace(l, {MARK}, '')) AS BIGINT) + 1)) AS k FROM (
    SELECT repo, file_path, unnest(ls) AS l, unnest(range(1, len(ls) + 1)) AS n FROM (
      SELECT repo, file_path, string_split(regexp_replace(content, {q(pattern)}, {MARK} || '\\0', 'g'), chr(10)) AS ls
      FROM kept)))"""


def block_ctes(name: str, weight: str, same_line: bool) -> dict[str, str]:
    """Recursive walk over the lines of each file; ``walk`` rows with ``closed`` are blocks."""
    late = "ln > s OR brace" if same_line else "ln > s"
    step = f"""
SELECT repo, file_path, ln, s, nm, d, w,
  (s > 0 AND d <= 0 AND ({late})) AS closed FROM (
  SELECT f.repo, f.file_path, f.line_number AS ln, f.brace,
    CASE WHEN (p.closed OR p.s = 0) AND f.name <> '' THEN f.line_number WHEN p.closed THEN 0 ELSE p.s END AS s,
    CASE WHEN (p.closed OR p.s = 0) THEN f.name ELSE p.nm END AS nm,
    CASE WHEN (p.closed OR p.s = 0) AND f.name = '' THEN 0 WHEN (p.closed OR p.s = 0) THEN f.delta ELSE p.d + f.delta END AS d,
    CASE WHEN (p.closed OR p.s = 0) AND f.name = '' THEN 0 WHEN (p.closed OR p.s = 0) THEN f.weight ELSE p.w + f.weight END AS w
  FROM walk p JOIN feat f ON f.repo = p.repo AND f.file_path = p.file_path AND f.line_number = p.ln + 1)"""
    return {
        "feat": f"""SELECT repo, file_path, line_number, {name} AS name, CAST({weight} AS BIGINT) AS weight,
  CAST(len(replace(line, '}}', '')) - len(replace(line, '{{', '')) AS BIGINT) AS delta, contains(line, '}}') AS brace FROM lines""",
        "walk": f"""SELECT DISTINCT repo, file_path, 0 AS ln, 0 AS s, '' AS nm, CAST(0 AS BIGINT) AS d, CAST(0 AS BIGINT) AS w,
  false AS closed FROM feat WHERE name <> '' UNION ALL ({step})""",
    }


METHODS = block_ctes(f"regexp_extract(line, {q(METHOD)}, 1)", f"len(regexp_extract_all(line, {q(BRANCH)}))", False)
METHODS["methods"] = (
    "SELECT repo, file_path, nm AS name, s AS line_number, ln - s AS length, CAST(w + 1 AS BIGINT) AS complexity FROM walk WHERE closed"
)


def statements() -> dict[str, str]:
    out: dict[str, str] = {}
    out["large_file_tiers"] = sql("kept", f"""
SELECT {core('1', 'Critical', 'Quality', 'Massive File Detected', 'Hard')} FROM kept WHERE len(string_split(content, chr(10))) > 1000
UNION ALL SELECT {core('1', 'Warning', 'Quality', 'Large File Detected', 'Medium')} FROM kept
WHERE len(string_split(content, chr(10))) BETWEEN 501 AND 1000""")
    out["method_metrics"] = sql("lines", "SELECT * FROM methods", **METHODS)
    out["method_findings"] = sql("lines", " UNION ALL ".join(
        f"SELECT {core('line_number', sev, 'Quality', title, eff)} FROM methods WHERE {cond}"
        for sev, title, eff, cond in [
            ("Critical", "God Method Detected", "Hard", "length > 100"),
            ("Warning", "Long Method Detected", "Medium", "length BETWEEN 51 AND 100"),
            ("Critical", "Extreme Cyclomatic Complexity", "Hard", "complexity > 20"),
            ("Warning", "High Cyclomatic Complexity", "Medium", "complexity BETWEEN 11 AND 20"),
        ]), **METHODS)
    out["nesting_depth"] = sql("kept", f"""
SELECT {core('n', 'Warning', 'Quality', 'Deep Nesting Detected', 'Medium')} FROM (
  SELECT repo, file_path, arg_min(n, (-depth, pos)) AS n, max(depth) AS depth FROM (
    SELECT *, sum(CASE t WHEN '{{' THEN 1 WHEN '}}' THEN -1 ELSE 0 END) OVER w AS depth,
      1 + sum(CASE WHEN t = chr(10) THEN 1 ELSE 0 END) OVER w AS n
    FROM (SELECT repo, file_path, unnest(ts) AS t, unnest(range(len(ts))) AS pos FROM (
      SELECT repo, file_path, regexp_extract_all(content, '[{{}}\\n]') AS ts FROM kept))
    WINDOW w AS (PARTITION BY repo, file_path ORDER BY pos)) GROUP BY repo, file_path)
WHERE depth >= 5""")
    out["empty_catch"] = sql("kept", content_matches(EMPTY_CATCH, core("n", "Warning", "Quality", "Empty Exception Handler")))
    own = "NOT contains(lower(file_path), 'test') AND NOT contains(lower(file_path), 'spec')"
    out["console_output"] = sql("lines", " UNION ALL ".join(
        f"SELECT {core('line_number', 'Info', 'Quality', t)} FROM lines WHERE {own} AND regexp_matches(line, {q(p)})"
        for t, p in [("Console.WriteLine in Production", r"^\s*Console\.WriteLine\("),
                     ("System.out.println in Production", r"^\s*System\.out\.println\(")]))
    py = f"({EXT} IN ('.py', '.pyw', '.PY') OR {NAME} IN ('requirements.txt', 'pipfile'))"
    out["commented_code_blocks"] = sql("lines", f"""
SELECT {core('line_number', 'Info', 'Quality', 'Commented Out Code Block')} FROM (
  SELECT *, lead(k) OVER w AS k1, lead(k, 2) OVER w AS k2, lag(k) OVER w AS k0 FROM (
    SELECT repo, file_path, line_number, CASE WHEN regexp_matches(line, '^\\s*//') THEN 2
      WHEN {py} AND regexp_matches(line, '^\\s*#') THEN 1 ELSE 0 END AS k FROM lines)
  WINDOW w AS (PARTITION BY repo, file_path ORDER BY line_number))
WHERE k > 0 AND k1 = k AND k2 = k AND coalesce(k0, 0) <> 2""")
    out["static_mutable_state"] = sql("kept", content_matches(
        STATIC, core("n", "Critical", "Quality", "Static Mutable State Detected", "Medium")))
    out["bool_param_trap"] = sql("kept", content_matches(
        SIG + r"\s*bool\s+\w", core("n", "Warning", "Quality", "Boolean Parameter Trap")))
    out["local_time_usage"] = sql("lines", f"""
SELECT {core('line_number', 'Warning', 'Quality', 'DateTime.Now Instead of DateTime.UtcNow')} FROM (
  SELECT repo, file_path, line_number, unnest(regexp_extract_all(regexp_replace(line, '^.*Utc', 'Utc'),
    '\\bDateTime\\.Now\\b')) FROM lines WHERE contains(line, 'DateTime.Now'))""")
    out["task_blocking"] = sql("kept", content_matches(
        r"\.(Result|Wait\(\))\s*;", core("n", "Warning", "Quality", "Synchronous Task Blocking (.Result/.Wait())", "Medium")))
    out["thread_sleep"] = sql("kept", content_matches(
        r"Thread\.Sleep\(", core("n", "Warning", "Quality", "Thread.Sleep in Async Code")))
    out["long_param_list"] = sql("kept", content_matches(
        SIG + r"[^)]{200,}\)", core("n", "Info", "Quality", "Method Has Too Many Parameters")))
    out["duplicate_blocks"] = sql("lines", f"""
SELECT {core('line_number', 'Warning', 'Quality', 'Duplicate Code Block', 'Medium')}, file_count, description FROM (
  SELECT s.repo, first.f AS file_path, first.l AS line_number, file_count,
    'The same 8 lines are at: ' || (SELECT string_agg(file_path || ':' || l, ', ' ORDER BY file_path) FROM (
       SELECT file_path, l FROM seen x WHERE x.repo = s.repo AND x.block = s.block ORDER BY file_path LIMIT 3)) AS description
  FROM (SELECT repo, block, count(*) AS file_count, min({{'f': file_path, 'l': l}}) AS first
    FROM seen GROUP BY repo, block HAVING count(*) >= 2) s)""",
        norm="SELECT repo, file_path, line_number, lower(regexp_replace(line, '^\\s+|\\s+$', '', 'g')) AS t FROM lines",
        seen="""SELECT repo, block, file_path, min(line_number) AS l FROM (
  SELECT repo, file_path, line_number, regexp_replace(string_agg(t, chr(10)) OVER w, '^\\s+|\\s+$', '', 'g') AS block,
    count(*) OVER w AS n FROM norm
  WINDOW w AS (PARTITION BY repo, file_path ORDER BY line_number ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING))
  WHERE n = 8 AND length(block) >= 40 GROUP BY repo, block, file_path""")
    out["circular_imports"] = sql("kept", f"""
SELECT DISTINCT {core('1', 'Critical', 'Quality', 'Circular Dependency Detected', 'Hard')},
  'Import loop between ' || regexp_extract(file_path, '[^/]*$') || ' and ' || regexp_extract(dest, '[^/]*$') || '.' AS description
FROM (SELECT i.repo, i.file_path, arg_min(r.dest, (i.pos, r.dest)) AS dest
  FROM imports i JOIN resolved r ON i.repo = r.repo AND i.target = r.target
  JOIN imports b ON b.repo = i.repo AND b.file_path = r.dest AND contains(lower(i.file_path), b.target)
  GROUP BY i.repo, i.file_path)""",
        imports=r"""SELECT repo, file_path, target, min(pos) AS pos FROM (
  SELECT repo, file_path, lower(regexp_replace(unnest(m), '^(#include\s*[<"]|using\s+)', '')) AS target, unnest(range(len(m))) AS pos
  FROM (SELECT repo, file_path, regexp_extract_all(content, '#include\s*[<"]([^\s>"]+)|using\s+([\w\.]+)\b') AS m FROM kept))
  WHERE target <> '' GROUP BY repo, file_path, target""",
        resolved="""SELECT i.repo, i.target, min(k.file_path) AS dest FROM (SELECT DISTINCT repo, target FROM imports) i
  JOIN kept k ON k.repo = i.repo AND contains(lower(k.file_path), i.target) GROUP BY i.repo, i.target""")
    return out
