"""Comparison SQL: dependencies."""

from __future__ import annotations

from oracle.base import q, sql, values
from oracle.corpus import EXT, NAME
from oracle.quality import core
from sievebase.rules import advisories

PARTS = "list_transform(string_split(split_part({0}, '-', 1), '.'), lambda p: coalesce(TRY_CAST(p AS INT), 0))"


def older(a: str, b: str) -> str:
    """Compare padded to eight parts, which covers every version here."""
    def padded(v: str) -> str:
        return f"list_resize({PARTS.format(v)}, 8, 0)"

    return f"{padded(a)} < {padded(b)}"


def vulnerable(rows: list[tuple], lines: str, version: str, named: str) -> str:
    table = values([(p, s, sev) for p, s, sev, _, _ in rows], "k(package, safe, severity)")
    body = core("line_number", "@", "Dependency", "@").replace("'@' AS severity", "severity").replace(
        "'@' AS title", "'Vulnerable: ' || package || ' ' || version AS title")
    return f"""SELECT {body} FROM (SELECT *, regexp_extract(line, {q(version)}, 1) AS version FROM {lines}) l
JOIN {table} ON {named} WHERE version <> '' AND {older('version', 'safe')}"""


PY = f"""(SELECT repo, file_path, line_number, trim(line, ' ' || chr(9) || chr(13)) AS line FROM lines
  WHERE {NAME} IN ('requirements.txt', 'pipfile', 'pyproject.toml'))"""
PYL = f"(SELECT * FROM {PY} WHERE line <> '' AND NOT starts_with(line, '#'))"


def statements() -> dict[str, str]:
    def c(title: str, severity: str = "Warning", line: str = "line_number") -> str:
        return core(line, severity, "Dependency", title)

    npm = f"(SELECT * FROM lines WHERE {NAME} = 'package.json')"
    out: dict[str, str] = {}
    low = "lower(file_path)"
    out["missing_lockfile"] = sql("kept", f"""
SELECT {c('No Lockfile Found (npm)', line='1')} FROM (SELECT repo, min(file_path) FILTER ({low} LIKE '%package.json') AS file_path,
  bool_or(contains({low}, 'lock')) AS l FROM kept GROUP BY repo) WHERE file_path IS NOT NULL AND NOT l
UNION ALL
SELECT {c('No Lockfile Found (Python)', line='1')} FROM (SELECT repo, min(file_path) FILTER ({low} LIKE '%requirements.txt') AS file_path,
  bool_or({low} LIKE '%requirements.lock') AS l FROM kept GROUP BY repo) WHERE file_path IS NOT NULL AND NOT l""")
    out["duplicate_json_keys"] = sql("lines", f"""
SELECT {c('@').replace("'@' AS title", "'Duplicate Package: ' || k AS title")}, description FROM (
  SELECT repo, file_path, k, min(line_number) AS line_number, 'Key ' || k || ' is on ' || count(*) || ' lines.' AS description
  FROM (SELECT *, regexp_extract(line, '"([\\w\\-@/]+)"\\s*:', 1) AS k FROM {npm}) WHERE k <> ''
  GROUP BY repo, file_path, k HAVING count(*) > 1)""")
    out["wildcard_versions"] = sql("lines", f"""
SELECT {c('Wildcard Version Dependency')} FROM {npm} WHERE contains(line, '"*"') UNION ALL
SELECT {c('Unpinned/Wildcard Dependency Version')} FROM {PYL} WHERE contains(line, '*') OR contains(line, 'latest')""")
    out["vulnerable_npm"] = sql("lines", vulnerable(
        advisories.NPM, npm, r'"[~^>=<]*(\d+\.\d+[\.\d]*)"', "contains(lower(line), '\"' || lower(package) || '\"')"))
    out["vulnerable_python"] = sql("lines", vulnerable(
        advisories.PYTHON, PYL, r"[><=~!]+\s*(\d+\.\d+[\.\d]*)", "starts_with(lower(line), lower(package))"))
    out["vulnerable_dotnet"] = sql("lines", vulnerable(
        advisories.DOTNET, f"(SELECT * FROM lines WHERE {EXT} = '.csproj' AND contains(line, 'PackageReference'))",
        r'Version\s*=\s*"(\d+\.\d+[\.\d]*)"', "contains(lower(line), lower(package))"))
    csproj = f"(SELECT * FROM lines WHERE {EXT} = '.csproj' AND contains(line, 'PackageReference'))"

    def listed(kind: str, source: str, version: str, named: str) -> str:
        return f"""SELECT repo, file_path, CAST(line_number AS INT) AS line_number, severity, 'Dependency' AS category,
  'Vulnerable: ' || package || ' ' || version AS title, 'Easy' AS effort_level, 0 AS confidence_score, advisory_id, ecosystem,
  remark || coalesce('; safe from ' || fixed || '.', '; no safe version.') AS description
FROM (SELECT *, regexp_extract(line, {q(version)}, 1) AS version FROM {source}) l JOIN advisories ON ecosystem = {q(kind)} AND {named}
WHERE version <> '' AND (introduced IS NULL OR NOT {older('version', 'introduced')}) AND (fixed IS NULL OR {older('version', 'fixed')})"""

    out["vulnerable_packages"] = sql("lines advisories", " UNION ALL ".join([
        listed("npm", npm, r'"[~^>=<]*(\d+\.\d+[\.\d]*)"', "contains(lower(line), '\"' || lower(package) || '\"')"),
        listed("python", PYL, r"[><=~!]+\s*(\d+\.\d+[\.\d]*)", "starts_with(lower(line), lower(package))"),
        listed("dotnet", csproj, r'Version\s*=\s*"(\d+\.\d+[\.\d]*)"', "contains(lower(line), lower(package))"),
    ]))
    out["unpinned_other"] = sql("lines", f"""
SELECT {c('Unpinned Ruby Gem')} FROM lines WHERE {NAME} = 'gemfile' AND contains(line, 'gem ')
  AND NOT contains(line, '~>') AND NOT contains(line, ''',')
UNION ALL SELECT {c('Go Pseudo-version or Incompatible Module', 'Info')} FROM lines WHERE {NAME} = 'go.mod'
  AND (contains(line, 'v0.0.0-') OR contains(line, '+incompatible'))
UNION ALL SELECT {c('SNAPSHOT Dependency in POM')} FROM lines WHERE {NAME} = 'pom.xml'
  AND contains(line, '<version>') AND contains(line, 'SNAPSHOT')""")
    out["advisory_staleness"] = sql("kept", f"""
SELECT repo, rule_set, count(*) AS manifests, '2024-11-15' AS last_updated,
  CAST(date_diff('day', DATE '2024-11-15', DATE '2025-06-01') AS INT) AS age_days
FROM (SELECT repo, CASE WHEN {NAME} = 'package.json' THEN 'npm' WHEN {NAME} IN ('requirements.txt', 'pipfile', 'pyproject.toml')
  THEN 'python' WHEN {EXT} = '.csproj' THEN 'dotnet' END AS rule_set FROM kept)
WHERE rule_set IS NOT NULL AND DATE '2025-06-01' - DATE '2024-11-15' > 90 GROUP BY repo, rule_set""")
    out["semver_compare"] = sql("", f"""
SELECT *, CASE WHEN {older('a', 'b')} THEN -1 WHEN {older('b', 'a')} THEN 1 ELSE 0 END AS cmp FROM (
  SELECT DISTINCT l_linenumber || '.' || (l_partkey % 12) || '.' || (l_suppkey % 4) || CASE l_returnflag WHEN 'R' THEN '-rc.1' ELSE '' END AS a,
    (l_linenumber % 5) || '.' || (CAST(l_quantity AS INT) % 12) || CASE l_returnflag WHEN 'A' THEN '.0' WHEN 'N' THEN '.x.2' ELSE '' END AS b
  FROM lineitem)""")
    return out
