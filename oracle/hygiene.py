"""Comparison SQL: structure, hygiene and API surface."""

from __future__ import annotations

from oracle.base import q, sql
from oracle.corpus import EXT
from oracle.quality import core
from sievebase.operators import api_surface as api

FN = "regexp_extract(file_path, '[^/]*$')"


def endpoint_ctes() -> dict[str, str]:
    def rule(pattern: str, framework: str, method: str, route: str) -> str:
        return (
            f"SELECT repo, file_path, line_number, {q(framework)} AS framework, {method} AS method, {route} AS route"
            f" FROM lines WHERE regexp_matches(line, {q(pattern)})"
        )

    def g(pattern: str, i: int) -> str:
        return f"regexp_extract(line, {q(pattern)}, {i})"

    asp_route = f"CASE WHEN {g(api.ASPNET, 2)} <> '' OR contains({g(api.ASPNET, 0)}, '(') THEN {g(api.ASPNET, 2)} ELSE '(controller default)' END"
    flask = f"CASE WHEN {g(api.FLASK, 2)} = '' THEN 'GET' ELSE upper(trim({g(api.FLASK, 2)}, '''\" ')) END"
    return {
        "endpoints": " UNION ALL ".join([
            rule(api.EXPRESS, "Express.js", f"upper({g(api.EXPRESS, 1)})", g(api.EXPRESS, 2)),
            rule(api.ASPNET, "ASP.NET", f"upper({g(api.ASPNET, 1)})", asp_route),
            rule(api.DJANGO, "Django", "'ANY'", g(api.DJANGO, 1)),
            rule(api.FLASK, "Flask", flask, g(api.FLASK, 1)),
            rule(api.FASTAPI, "FastAPI", f"upper({g(api.FASTAPI, 1)})", g(api.FASTAPI, 2)),
        ]),
        "protected": f"""
SELECT e.*, regexp_matches(context, {q(api.AUTH)}) OR (contains(lower(content), 'app.use(') AND regexp_matches(content, {q(api.AUTH)})) AS has_auth,
  regexp_matches(context, {q(api.VALIDATION)}) AS has_validation, regexp_matches(content, {q(api.RATE_LIMIT)}) AS has_rate_limit
FROM (SELECT e.*, k.content, (SELECT string_agg(line, chr(10) ORDER BY l.line_number) FROM lines l WHERE l.repo = e.repo
    AND l.file_path = e.file_path AND l.line_number BETWEEN e.line_number - 29 AND e.line_number + 40) AS context
  FROM endpoints e JOIN kept k ON k.repo = e.repo AND k.file_path = e.file_path) e""",
    }


API = endpoint_ctes()
MUT = "('POST', 'PUT', 'DELETE', 'PATCH')"
API_PARTS = {
    "unprotected_endpoints": (core("line_number", "Warning", "ApiSurface", "Unprotected API Endpoint", "Medium", 75), "NOT has_auth"),
    "unvalidated_endpoints": (core("line_number", "Info", "ApiSurface", "No Input Validation on Endpoint", "Easy", 50), "NOT has_validation"),
    "unlimited_mutations": (
        core("line_number", "Info", "ApiSurface", "No Rate Limiting on Mutating Endpoint", "Easy", 45),
        f"NOT has_rate_limit AND method IN {MUT}"),
}
API["api_findings"] = " UNION ALL ".join(f"SELECT {c} FROM protected WHERE {w}" for c, w in API_PARTS.values())


def statements() -> dict[str, str]:
    def s(title: str, severity: str = "Info", line: str = "1", effort: str = "Easy") -> str:
        return core(line, severity, "Structure", title, effort)

    def lack(flag: str, path: str, title: str, severity: str = "Info") -> str:
        return f"SELECT {s(title, severity, '0').replace('file_path', q(path) + ' AS file_path', 1)} FROM has WHERE NOT {flag}"

    low = "lower(file_path)"
    out: dict[str, str] = {}
    out["repo_presence_checks"] = sql("kept", " UNION ALL ".join([
        lack("ig", ".gitignore", "No .gitignore File", "Warning"), lack("rd", "README.md", "No README Found"),
        lack("ts", "", "No Tests Detected"), lack("ci", "", "No CI/CD Configuration"), lack("li", "LICENSE", "No License File"),
    ]), has=f"""SELECT repo, bool_or({low} LIKE '%.gitignore') AS ig, bool_or(regexp_matches({low}, 'readme(\\.md|\\.txt)?$')) AS rd,
  bool_or(regexp_matches({low}, 'test|spec')) AS ts, bool_or(regexp_matches(file_path,
    '\\.github/workflows|\\.gitlab-ci|\\.travis\\.yml|Jenkinsfile|azure-pipelines|\\.circleci')) AS ci,
  bool_or(regexp_matches({low}, 'licen[sc]e')) AS li FROM kept GROUP BY repo""")
    out["env_files"] = sql("kept", f"""
SELECT {s('Secrets File May Be Committed', 'Warning')} FROM env WHERE NOT ignored
UNION ALL SELECT {s('Environment-Specific Secrets File', 'Warning')} FROM env WHERE {FN} IN ('.env.production', '.env.local')
UNION ALL SELECT {s('Environment File Committed', 'Critical')} FROM env""",
        env=f"""SELECT k.repo, k.file_path, contains(coalesce(g.content, ''), '.env') AS ignored FROM kept k
  LEFT JOIN (SELECT repo, arg_min(content, file_path) AS content FROM kept WHERE file_path LIKE '%.gitignore' GROUP BY repo) g USING (repo)
  WHERE {FN} LIKE '.env%'""")
    out["oversize_and_binary"] = sql("file_listing", f"""
SELECT {s('Large File Committed', 'Warning')} FROM file_listing WHERE round_even(size_bytes / 1024.0, 2) > 1024
UNION ALL SELECT {s('Binary Executable Committed', 'Warning')} FROM file_listing WHERE {EXT} IN ('.exe', '.dll')""")
    out["deep_paths"] = sql("kept", f"""SELECT {s('Deeply Nested Directory Structure', line='0')} FROM (
  SELECT repo, min(file_path) AS file_path FROM kept WHERE len(string_split(file_path, '/')) >= 7 GROUP BY repo)""")
    out["merge_markers"] = sql("kept", f"""SELECT {s('Merge Conflict Markers Left in Code', 'Warning')} FROM kept
WHERE regexp_matches(content, '(?m)^[<>=]{{7}}')""")
    out["ineffective_gitignore"] = sql("kept", f"""
SELECT {s('@', line='0').replace("'@' AS title", "'.gitignore Pattern Ineffective: ' || pattern AS title")} FROM (
  SELECT repo, '.gitignore' AS file_path, arg_min(pattern, pos) AS pattern FROM pats p
  WHERE EXISTS (SELECT 1 FROM kept k WHERE k.repo = p.repo AND contains(lower(k.file_path), target)) GROUP BY repo)""",
        pats="""SELECT repo, pos, pattern, rtrim(ltrim(pattern, '/'), '*/') AS target FROM (
  SELECT repo, unnest(range(len(ls))) AS pos, trim(unnest(ls), ' ' || chr(9) || chr(13)) AS pattern FROM (
    SELECT repo, string_split(arg_min(content, file_path), chr(10)) AS ls FROM kept WHERE file_path LIKE '%.gitignore' GROUP BY repo))
  WHERE pattern <> '' AND NOT starts_with(pattern, '#')""")
    out["committed_artifacts"] = sql("kept", f"""
SELECT {s('Log File Committed to Repository', 'Warning')} FROM kept
  WHERE file_path LIKE '%.log' OR file_path LIKE '%\\_log.txt' ESCAPE '\\' OR contains(file_path, '/logs/')
UNION ALL SELECT {s('Database Dump Committed', 'Critical', effort='Hard')} FROM kept
  WHERE {EXT} IN ('.sql', '.dump', '.backup', '.bak', '.db', '.sqlite')
UNION ALL SELECT {s('Git Editor Message File Committed', 'Warning')} FROM (
  SELECT repo, min(file_path) AS file_path FROM kept WHERE file_path LIKE '%COMMIT_EDITMSG' GROUP BY repo)""")
    out["missing_shebang"] = sql("kept", f"""SELECT {s('Script Missing Shebang Line')} FROM kept
WHERE lower({EXT}) IN ('.sh', '.bash', '.zsh', '.py', '.rb', '.pl') AND NOT starts_with(content, '#!')""")
    out["todo_first_per_file"] = sql("lines", f"""SELECT {s('TODO Comment in Source', line='n')} FROM (
  SELECT repo, file_path, min(line_number) AS n FROM lines WHERE regexp_matches(line, '(?i)todo')
    AND regexp_matches(line, '^\\s*(//|#|/\\*)') GROUP BY repo, file_path)""")
    wf = f"contains(file_path, '.github/workflows/') AND {EXT} IN ('.yml', '.yaml')"
    out["workflow_checks"] = sql("kept", f"""
SELECT {s('Outdated GitHub Action Version', 'Warning')} FROM kept WHERE {wf} AND regexp_matches(content, 'uses: actions/checkout@v[123]')
UNION ALL SELECT {s('Insecure pull_request_target checkout', 'Critical', effort='Medium')} FROM kept WHERE {wf}
  AND (contains(content, 'on: [pull_request_target]') OR contains(content, 'on:' || chr(10) || '  pull_request_target:'))
  AND contains(content, 'actions/checkout') AND NOT contains(content, 'ref: ${{{{ github.event.pull_request.head.sha }}}}')""")
    out["api_endpoints"] = sql("lines", "SELECT repo, file_path, line_number, framework, method, route FROM endpoints", **API)
    out["endpoint_protection"] = sql("lines", """SELECT repo, file_path, line_number, framework, method, route, has_auth,
  has_validation, has_rate_limit FROM protected""", **API)
    for name, (cols, where) in API_PARTS.items():
        out[name] = sql("lines", f"SELECT {cols} FROM protected WHERE {where}", **API)
    out["api_surface_summary"] = sql("lines", """
SELECT repo, count(*) FILTER (severity IN ('Warning', 'Critical')) AS unprotected,
  count(*) FILTER (contains(title, 'Validation')) AS no_validation, count(*) FILTER (contains(title, 'Rate')) AS no_rate_limit,
  count(*) AS findings FROM api_findings GROUP BY repo""", **API)
    return out
