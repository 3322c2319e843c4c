"""Comparison SQL: git forensics."""

from __future__ import annotations

from oracle.base import q, sql
from oracle.quality import core
from sievebase.rules import git_facts as facts

OBJ = "'.git/objects/' || substr(hash, 1, 2) || '/' || substr(hash, 3)"
LOST = "reach IN ('unreachable', 'dangling')"


def row(line: str, severity: str, title: str, effort: str, score: str, path: str = "file_path", category: str = "Security") -> str:
    return (
        f"repo, {path} AS file_path, CAST({line} AS INT) AS line_number, {q(severity)} AS severity, {q(category)} AS category,"
        f" {title} AS title, {q(effort)} AS effort_level, {score} AS confidence_score"
    )


def secret_hits(table: str, text: str, keys: str) -> str:
    lines = f"""(SELECT {keys}, unnest(string_split({text}, chr(10))) AS line, unnest(range(1, len(string_split({text}, chr(10))) + 1)) AS n FROM {table})"""
    parts = []
    for i, (kind, pattern, score) in enumerate(facts.OBJECT_SECRETS):
        found = f"regexp_extract_all(line, {q(pattern)})"
        found = f"list_distinct({found})" if i == 0 else found
        parts.append(f"SELECT {keys}, n, {q(kind)} AS kind, {score} AS score FROM (SELECT {keys}, n, unnest({found}) FROM {lines})")
    return " UNION ALL ".join(parts)


def statements() -> dict[str, str]:
    out: dict[str, str] = {}
    out["dangling_blob_secrets"] = sql("git_objects", f"""
SELECT {row('min(n)', 'Critical', "'[DANGLING BLOB ' || hash || '] ' || kind", 'Hard', 'min(score)', OBJ)}, hash AS commit_hash
FROM ({secret_hits('blobs', 'content', 'repo, hash')}) GROUP BY repo, hash, kind""",
        blobs=f"SELECT * FROM git_objects WHERE obj_type = 'blob' AND {LOST}")
    out["unreachable_sensitive_commits"] = sql("git_objects", f"""
SELECT {row('0', 'Warning', "'Unreachable Commit Contains Sensitive Files'", 'Hard', '80', OBJ)} FROM git_objects
WHERE obj_type = 'commit' AND {LOST} AND regexp_matches(touched_paths, '\\.env|config|secret|password')""")
    out["reflog_sensitive_messages"] = sql("reflog", f"""
SELECT {row('0', 'Warning', "'Sensitive Keyword in Commit Message'", 'Hard', '55',
            "'.git/logs/refs/' || replace(replace(ltrim(entry, '@'), '{', ''), '}', '')")}, hash AS commit_hash,
  strftime(ts, '%Y-%m-%d %H:%M:%S') AS commit_date FROM (
  SELECT *, row_number() OVER (PARTITION BY repo, hash ORDER BY ts DESC, entry DESC) AS r2 FROM reflog)
WHERE r2 = 1 AND regexp_matches(message, '(?i)password|secret|token|key')""")
    out["stash_secrets"] = sql("stashes", f"""
SELECT {row('n', 'Critical', "'Secret in Git Stash: [STASH ' || ref_name || '] ' || kind", 'Hard', 'score', OBJ)}, hash AS commit_hash
FROM ({secret_hits('few', 'diff', 'repo, hash, ref_name')}) UNION ALL
SELECT {row('0', 'Warning', "'Sensitive Git Stash Message'", 'Easy', '65', "'.git/logs/refs/stash'")}, hash AS commit_hash
FROM few WHERE regexp_matches(message, '(?i)password|secret')""",
        few="SELECT * FROM stashes")
    lines_of = """SELECT repo, file_path, unnest(string_split(content, chr(10))) AS line,
  unnest(range(1, len(string_split(content, chr(10))) + 1)) AS n FROM code_corpus WHERE """
    out["git_config_exposure"] = sql("code_corpus", f"""
SELECT {row('n', 'Critical', "'Git Remote URL Contains Embedded Credentials'", 'Easy', '100')},
  'Remote ' || regexp_replace(rtrim(regexp_extract(line, '(?i)url\\s*=\\s*(.+)', 1)), '^(https?)://[^/@]+@([^/:]+)(:\\d+)?', '\\1://***:***@\\2') || ' holds a password.' AS description
FROM cfg WHERE contains(line, '://') AND contains(line, '@') UNION ALL
SELECT {row('n', 'Warning', "'Insecure HTTP Git Remote'", 'Easy', '95')}, 'The remote is reached without encryption.' FROM cfg
WHERE contains(lower(line), 'http://') AND NOT contains(line, 'localhost') AND NOT contains(line, '127.0.0.1')""",
        cfg=f"SELECT * FROM ({lines_of} regexp_matches(file_path, '(^|/)\\.git/config$')) WHERE contains(lower(line), 'url = ')")
    hooks = "FROM (SELECT *, regexp_extract(file_path, '[^/]*$') AS name FROM code_corpus WHERE regexp_matches(file_path, '(^|/)\\.git/hooks/[^/]+$'))"
    std = ", ".join(q(h) for h in facts.STANDARD_HOOKS)
    out["hook_forensics"] = sql("code_corpus", f"""
SELECT {row('0', 'Warning', "'Non-Standard Git Hook Detected'", 'Easy', '70')} {hooks} WHERE lower(name) NOT IN ({std}) UNION ALL
SELECT {row('0', 'Critical', "'Potentially Malicious Git Hook: ' || name", 'Easy', '90')} {hooks}
WHERE regexp_matches(lower(content), 'curl|wget|nc |netcat|bash -i|/dev/tcp/|password|secret|token')""")
    out["submodule_risks"] = sql("code_corpus", f"""
SELECT {row('n', 'Warning', "'Submodule Using Insecure HTTP'", 'Easy', '90')} FROM m WHERE contains(lower(line), 'url = ') AND contains(lower(line), 'http://')
UNION ALL SELECT {row('n', 'Critical', "'Submodule URL Contains Embedded Credentials'", 'Medium', '100')} FROM m
  WHERE contains(lower(line), 'url = ') AND contains(line, '@') AND contains(line, '://')
UNION ALL SELECT {row('n', 'Critical', "'Submodule Path Traversal'", 'Easy', '100')} FROM m WHERE contains(lower(line), 'path = ..')""",
        m=f"{lines_of} regexp_matches(file_path, '(^|/)\\.gitmodules$')")
    out["high_entropy_tokens"] = sql("lines", f"""
SELECT {core('line_number', 'Warning', 'Security', 'High Entropy Token', 'Medium')}, token, bits FROM (
  SELECT repo, file_path, line_number, token, round(-list_sum(list_transform(list_distinct(string_split(token, '')),
    lambda c: (length(token) - length(replace(token, c, ''))) / length(token) * log2((length(token) - length(replace(token, c, ''))) / length(token)))), 6) AS bits
  FROM (SELECT repo, file_path, line_number, unnest(list_distinct(regexp_extract_all(line, {q(facts.TOKEN)}))) AS token FROM lines)
  ) WHERE bits >= 3.5""")
    secret_kinds = lambda keys: " UNION ALL ".join(
        f"SELECT {keys}, {q(name)} AS name, unnest(regexp_extract_all(line, {q(p)})) AS v FROM ol" for name, p in facts.HISTORY_SIGNATURES
    )
    out["added_lines"] = sql("added", """
SELECT a.repo, a.commit, a.file_path, a.n AS line_number, md5(string_split(b.content, chr(10))[a.n]) AS line_md5
FROM added a JOIN git_blobs b ON b.repo = a.repo AND b.blob = a.blob""")
    out["commit_dates"] = sql("dates", "SELECT repo, commit, date FROM dates")
    out["history_secret_scan"] = sql("added dates", f"""
SELECT {row('p.n', 'Critical', "'Secret in Git History: ' || name", 'Hard', '95', 'p.path')}, p.hash AS commit_hash, uses FROM (
  SELECT repo, name, v, min({{'t': date, 'hash': commit, 'path': file_path, 'n': n}}) AS p, count(*) AS uses
  FROM ({secret_kinds('repo, commit, date, file_path, n')}) GROUP BY repo, name, v)""",
        ol="""SELECT a.repo, a.commit, d.date, a.file_path, a.n, string_split(b.content, chr(10))[a.n] AS line FROM added a
  JOIN git_blobs b ON b.repo = a.repo AND b.blob = a.blob JOIN dates d ON d.repo = a.repo AND d.commit = a.commit""")
    out["object_secret_scan"] = sql("git_objects", f"""
SELECT {row('p.n', 'Critical', "'Secret in Git History: ' || name", 'Hard', '95', OBJ.replace('hash', 'p.hash'))}, p.hash AS commit_hash, uses FROM (
  SELECT repo, name, v, min({{'t': commit_time, 'hash': hash, 'n': n}}) AS p, count(*) AS uses FROM (
    {secret_kinds('repo, hash, commit_time, n')})
  GROUP BY repo, name, v)""",
        ol="""SELECT repo, hash, commit_time, unnest(string_split(content, chr(10))) AS line,
  unnest(range(1, len(string_split(content, chr(10))) + 1)) AS n FROM git_objects""")
    out["large_pack_objects"] = sql("git_objects", f"""
SELECT {row('0', 'Info', "'Large Object in Pack File'", 'Hard', '40', "'.git/objects/pack/'", 'Structure')},
  'Object ' || hash || ' takes ' || (size_bytes // 1048576) || ' MB.' AS description FROM git_objects WHERE size_bytes > 10485760""")
    return out
