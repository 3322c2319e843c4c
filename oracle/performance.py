"""Comparison SQL: performance findings."""

from __future__ import annotations

from oracle.base import q, sql
from oracle.quality import block_ctes, core
from sievebase.operators import performance as perf

LOOPS = block_ctes(f"CASE WHEN regexp_matches(line, {q(perf.LOOP)}) THEN 'loop' ELSE '' END", "0", True)
LOOPS["spans"] = """SELECT repo, file_path, s AS first, max(CASE WHEN closed THEN ln END) AS last
  FROM walk WHERE s > 0 GROUP BY repo, file_path, s"""
LOOPS["ctx"] = """SELECT l.*, bool_or(l.line_number >= s.first AND (s.last IS NULL OR l.line_number <= s.last)) IS TRUE AS in_loop,
  bool_or(l.line_number >= s.first AND (s.last IS NULL OR l.line_number < s.last)) IS TRUE AS in_loop_after
  FROM lines l LEFT JOIN spans s ON l.repo = s.repo AND l.file_path = s.file_path GROUP BY ALL"""


def line_rule(pattern: str, cols: str, table: str = "lines", extra: str = "") -> str:
    return f"SELECT {cols} FROM {table} WHERE regexp_matches(line, {q(pattern)}) {extra}"


def statements() -> dict[str, str]:
    def c(severity: str, title: str, effort: str = "Easy") -> str:
        return core("line_number", severity, "Performance", title, effort)

    out: dict[str, str] = {}
    out["loop_context"] = sql("lines", "SELECT repo, file_path, line_number, in_loop, in_loop_after FROM ctx", **LOOPS)
    out["n_plus_one"] = sql("lines", line_rule(
        perf.DATA_ACCESS, c("Warning", "Potential N+1 Query", "Medium"), "ctx", "AND in_loop"), **LOOPS)
    out["concat_in_loop"] = sql("lines", line_rule(
        perf.TEXT_APPEND, c("Warning", "String Concatenation in Loop"), "ctx", "AND in_loop"), **LOOPS)
    out["linq_in_loop"] = sql("lines", line_rule(
        r"\.(Where|Select|Any)\(", c("Warning", "LINQ Operation Inside Loop (O(n²))", "Medium"), "ctx", "AND in_loop_after"), **LOOPS)
    out["sync_blocking_perf"] = sql("lines", line_rule(perf.BLOCKING, c("Warning", "Synchronous Task Blocking", "Medium")))
    out["thread_sleep_perf"] = sql("lines", line_rule(perf.SLEEP, c("Warning", "Thread.Sleep Usage")))
    out["large_allocation"] = sql("lines", line_rule(
        perf.BIG_ARRAY, c("Warning", "Large Memory Allocation", "Medium")
        + ", 'A byte array of ' || (size // 1000000) || ' MB.' AS description",
        "(SELECT *, TRY_CAST(regexp_extract(line, 'new\\s+byte\\[\\s*(\\d{8,})\\s*\\]', 1) AS BIGINT) AS size FROM lines)",
        "AND size > 10000000"))
    out["materialize_then_filter"] = sql("lines", line_rule(perf.TO_LIST_WHERE, c("Info", "Inefficient LINQ: ToList().Where()")))
    out["count_gt_zero"] = sql("lines", line_rule(perf.COUNT_ZERO, c("Info", "Use .Any() Instead of .Count() > 0")))
    out["undisposed_resource"] = sql("lines", line_rule(
        perf.RESOURCE, c("Warning", "IDisposable Without Using Statement"),
        "(SELECT *, lag(line) OVER (PARTITION BY repo, file_path ORDER BY line_number) AS before FROM lines)",
        f"AND NOT regexp_matches(line, {q(perf.USING)}) AND NOT contains(coalesce(before, ''), 'using')"))
    out["boxing_collections"] = sql("lines", line_rule(perf.BOXING, c("Warning", "Boxing in Hot Path")))
    out["split_without_options"] = sql("lines", line_rule(
        r"\.Split\s*\(\s*[^,)]*\)", c("Info", "String.Split Without StringSplitOptions"),
        "(SELECT repo, file_path, line_number, regexp_replace(line, '\\.Split\\s*\\(\\s*[^,)]*\\),\\s*StringSplitOptions', '#', 'g') AS line FROM lines)"))
    out["file_read_in_loop"] = sql("kept", f"""SELECT {core('1', 'Critical', 'Performance', 'File.ReadAllText Inside Loop', 'Hard')} FROM kept
WHERE regexp_matches(content, '(?s)foreach.*File\\.Read|for.*File\\.Read|while.*ReadLine')""")
    return out
