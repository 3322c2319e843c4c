"""Comparison SQL: corpus preparation and line rules."""

from __future__ import annotations

from oracle.base import SKIP_DIR_RX, SKIP_EXT_RX, q, rule_array, sql, values
from sievebase.rules import vocabulary as vocab
from sievebase.rules.line_rules import CREDENTIAL_TITLES, SECURITY_RULES

EXT = r"regexp_extract(file_path, '(\.[^./]+)$', 1)"
NAME = "lower(regexp_extract(file_path, '[^/]*$'))"
REASON = f"""CASE WHEN regexp_matches(lower(file_path), {q(SKIP_DIR_RX)}) THEN 'directory'
  WHEN regexp_matches(lower(file_path), '\\.min\\.(js|css)$') THEN 'minified'
  WHEN regexp_matches(lower(file_path), {q(SKIP_EXT_RX)}) THEN 'extension'
  WHEN size_bytes > 512000 THEN 'size' END"""


def _language() -> str:
    names = " ".join(f"WHEN {NAME} = {q(name)} THEN {q(lang)}" for name, lang in vocab.LANGUAGE_BY_NAME.items())
    exts = " ".join(f"WHEN lower({EXT}) = {q(ext)} THEN {q(lang)}" for ext, lang in vocab.LANGUAGE_BY_EXTENSION.items())
    return f"CASE WHEN {NAME} LIKE 'dockerfile.%' THEN 'Docker' {names} {exts} ELSE 'Other' END"


RULES = values(
    [
        (i, r.title, r.severity, "Medium" if r.severity == "Critical" else "Easy", r.why, r.advice)
        for i, r in enumerate(SECURITY_RULES)
    ],
    "t(rule, title, severity, effort_level, description, suggestion)",
)
SECURITY_CTES = {
    "hits": "SELECT repo, file_path, line_number, unnest(list_filter("
    + rule_array("line", [(i, r.pattern) for i, r in enumerate(SECURITY_RULES)])
    + ", lambda x: x IS NOT NULL)) AS rule FROM lines WHERE regexp_matches(line, '\\S')",
    "security": "SELECT repo, file_path, line_number, severity, 'Security' AS category, title, effort_level,"
    f" 0 AS confidence_score, description, suggestion FROM hits JOIN (SELECT * FROM {RULES}) USING (rule)",
}
CREDS = ", ".join(q(t) for t in CREDENTIAL_TITLES)


def statements() -> dict[str, str]:
    out: dict[str, str] = {}
    out["corpus_files"] = sql("file_listing", f"""
SELECT repo, file_path, {EXT} AS extension, round_even(size_bytes / 1024.0, 2) AS size_kb,
  CAST(len(string_split(content, chr(10))) AS INT) AS line_count FROM file_listing""")
    out["corpus_filter"] = sql("file_listing", f"SELECT repo, file_path, size_bytes, {REASON} AS skip_reason FROM file_listing")
    out["language_classify"] = sql("file_listing", f"SELECT repo, file_path, {_language()} AS language FROM file_listing")
    out["corpus_lines"] = sql("lines", "SELECT repo, file_path, line_number, line FROM lines")
    out["corpus_stats"] = sql("file_listing", """
SELECT t.*, coalesce(top_languages, '') AS top_languages FROM (
  SELECT repo, count(*) AS total_found, count(*) FILTER (skip_reason IS NOT NULL) AS total_skipped,
    count(*) FILTER (skip_reason IS NULL) AS total_files,
    CAST(sum(len(string_split(content, chr(10)))) FILTER (skip_reason IS NULL) AS BIGINT) AS total_lines,
    count(DISTINCT folder) FILTER (skip_reason IS NULL AND folder <> '') AS directory_count
  FROM seen GROUP BY repo) t
LEFT JOIN (SELECT repo, string_agg(language || ':' || n, ', ' ORDER BY n DESC, language) AS top_languages FROM (
  SELECT repo, language, count(*) AS n, row_number() OVER (PARTITION BY repo ORDER BY count(*) DESC, language) AS rk
  FROM seen WHERE skip_reason IS NULL GROUP BY repo, language) WHERE rk <= 5 GROUP BY repo) l USING (repo)""",
        seen=f"""SELECT * FROM (SELECT repo, content, {REASON} AS skip_reason, {_language()} AS language,
  regexp_extract(file_path, '^(.*)/[^/]*$', 1) AS folder FROM file_listing) WHERE skip_reason IS DISTINCT FROM 'directory'""")
    out["repo_url_normalize"] = sql("repo_urls", r"""
SELECT page_id, url, reason, CASE WHEN reason IS NULL THEN parts[1] END AS owner,
  CASE WHEN reason IS NULL THEN parts[2] END AS name,
  CASE WHEN reason IS NULL THEN clean || '.git' END AS clone_url
FROM (SELECT *, CASE WHEN trim(url) = '' THEN 'empty' WHEN NOT regexp_matches(lower(clean), '^https?://') THEN 'scheme'
    WHEN contains(clean, '@') THEN 'credentials' WHEN host = '' THEN 'invalid'
    WHEN host IN ('localhost', '[::1]') THEN 'local address'
    WHEN regexp_matches(host, '^(0|10|127)\.\d+\.\d+\.\d+$|^169\.254\.|^192\.168\.|^172\.(1[6-9]|2\d|3[01])\.|^\[fe[89ab][0-9a-f]:')
      THEN 'private address'
    WHEN host NOT IN ('github.com', 'gitlab.com', 'bitbucket.org', 'dev.azure.com') THEN 'host'
    WHEN len(parts) < 2 THEN 'path' END AS reason
  FROM (SELECT *, lower(regexp_extract(clean, '(?i)^https?://([^/:?#]*@)?([^/:?#]*)', 2)) AS host,
      list_filter(string_split(regexp_extract(clean, '(?i)^https?://[^/?#]*([^?#]*)', 1), '/'), lambda p: p <> '') AS parts
    FROM (SELECT page_id, url, regexp_replace(regexp_replace(rtrim(trim(url), '/'),
        '(?i)^(.+?)/(tree|blob)/.*$', '\1'), '(?i)\.git$', '') AS clean FROM repo_urls)))""")
    out["security_rule_scan"] = sql("lines", """
SELECT repo, file_path, line_number, severity, category, title, effort_level, confidence_score, suggestion FROM security""",
        **SECURITY_CTES)
    out["rule_hit_rollup"] = sql("lines", """
SELECT title, count(*) AS instances, count(DISTINCT (repo, file_path)) AS file_count,
  arg_min(severity, (repo, file_path, line_number, severity)) AS severity,
  arg_min(suggestion, (repo, file_path, line_number, severity)) AS suggestion FROM security GROUP BY title""", **SECURITY_CTES)
    fam = """CASE WHEN title LIKE '%Password%' THEN 'password' WHEN title LIKE '%Connection String%' THEN 'connection_string'
  WHEN regexp_matches(title, 'Private Key|SSH|GPG') THEN 'private_key' WHEN title LIKE '%Token%' THEN 'token'
  WHEN title LIKE '%Secret%' THEN 'secret' WHEN regexp_matches(title, 'API Key|Access Key|Public Key') THEN 'service_key'
  ELSE 'other' END"""
    names = ("password", "connection_string", "private_key", "token", "secret", "service_key", "other")
    counts = ", ".join(f"count(*) FILTER ({fam} = '{n}') AS {n}" for n in names)
    out["secret_family_rollup"] = sql("lines", f"""
SELECT repo, severity, {counts} FROM security WHERE title IN ({CREDS}) GROUP BY repo, severity""", **SECURITY_CTES)
    out["batch_fix_bundle"] = sql("lines", """
SELECT title, repo, file_path, line_number, '--- File: ' || file_path || ' ---' || chr(10) || suggestion AS fix_text
FROM security WHERE suggestion <> ''""", **SECURITY_CTES)
    return out
