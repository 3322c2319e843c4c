"""Secrets and risks in git facts given as tables.

All objects are searched. A limit per repository may be given; it ranks and is
filtered on ``row_number``, so Spark cuts each partition before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievebase.functions.findings import as_rows, finding, with_lines
from sievebase.functions.text import explode_lines, file_name, let, split_lines
from sievebase.operators import line_history
from sievebase.rules import git_facts as facts


def _sec(line, severity, title, why, advice, effort, score, commit=None, date=None, reach="Active", category="Security"):
    return finding(line, severity, category, title, why, advice, effort, score, commit=commit, commit_date=date, reach=reach)


def _first(df: DataFrame, n: int | None, *order) -> DataFrame:
    if n is None:
        return df
    rank = F.row_number().over(Window.partitionBy("repo").orderBy(*order))
    return df.withColumn("rank", rank).filter(F.col("rank") <= n).drop("rank")


def _object_path(hash_: Column) -> Column:
    return F.concat(F.lit(".git/objects/"), F.substring(hash_, 1, 2), F.lit("/"), F.substring(hash_, 3, 100))


def _lost(objects: DataFrame, kind: str) -> DataFrame:
    return objects.filter(F.col("reach").isin("unreachable", "dangling") & (F.col("obj_type") == kind))


def _secret_hits(content: Column) -> Column:
    """Every secret in a text: line, kind and score; equal matches of a line once."""
    def of_kind(l: Column, i: Column, kind: str, pattern: str, score: int) -> Column:
        found = F.regexp_extract_all(l, F.lit(pattern), F.lit(0))
        distinct = F.array_distinct(found) if kind == facts.OBJECT_SECRETS[0][0] else found
        return F.transform(
            distinct,
            lambda m: F.struct((i + 1).alias("line"), F.lit(kind).alias("kind"), F.lit(score).alias("score")),
        )

    def hits(l: Column, i: Column) -> Column:
        return F.concat(*[of_kind(l, i, *entry) for entry in facts.OBJECT_SECRETS])

    maybe = content.rlike(r"(?i)passw|secret|api_?key|token|private_key|eyJ|AKIA")
    hit_type = "array<struct<line:int,kind:string,score:int>>"
    return F.when(maybe, F.flatten(F.transform(split_lines(content), hits))).otherwise(F.array().cast(hit_type))


def dangling_blob_secrets(objects: DataFrame, max_blobs: int | None = None) -> DataFrame:
    """Secrets in unreachable blobs, the first of each kind per blob."""
    blobs = _first(_lost(objects, "blob"), max_blobs, "hash")
    hits = blobs.select("repo", "hash", F.inline(_secret_hits(F.col("content"))))
    once = hits.groupBy("repo", "hash", "kind").agg(F.min("line").alias("line"), F.first("score").alias("score"))
    prefix = F.concat(F.lit("[DANGLING BLOB "), "hash", F.lit("] "))
    return as_rows(
        once.withColumn("file_path", _object_path(F.col("hash"))),
        _sec(F.col("line"), "Critical", F.concat(prefix, "kind"), "A lost object still holds a secret.",
             "Purge the object and replace the secret.", "Hard", F.col("score"), F.col("hash"), reach="DanglingBlob"),
    )


def unreachable_sensitive_commits(objects: DataFrame, max_commits: int | None = None) -> DataFrame:
    commits = _first(_lost(objects, "commit"), max_commits, "hash")
    touched = None
    for word in facts.SENSITIVE_PATHS:
        hit = F.col("touched_paths").contains(word)
        touched = hit if touched is None else touched | hit
    return as_rows(
        commits.filter(touched).withColumn("file_path", _object_path(F.col("hash"))),
        _sec(0, "Warning", "Unreachable Commit Contains Sensitive Files", F.concat(F.lit("Commit "), "hash", F.lit(" can still be recovered.")),
             "Expire the log and collect garbage.", "Hard", 80, reach="UnreachableCommit"),
    )


def reflog_sensitive_messages(reflog: DataFrame, max_entries: int | None = None) -> DataFrame:
    """Newest entries, the newest per commit, whose message names a secret."""
    newest = (F.desc("ts"), F.desc("entry"))
    recent = _first(reflog, max_entries, *newest)
    rank = F.row_number().over(Window.partitionBy("repo", "hash").orderBy(*newest))
    once = recent.withColumn("rank", rank).filter((F.col("rank") == 1) & F.col("message").rlike(facts.SENSITIVE_WORDS))
    path = F.concat(F.lit(".git/logs/refs/"), F.translate(F.ltrim("entry", F.lit("@")), "{}", ""))
    return as_rows(
        once.withColumn("file_path", path),
        _sec(0, "Warning", "Sensitive Keyword in Commit Message", F.concat(F.lit("Entry "), "entry", F.lit(" names a secret.")),
             "Rewrite the message.", "Hard", 55, F.col("hash"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "ReflogEntry"),
    )


def stash_secrets(stashes: DataFrame, max_stashes: int | None = None) -> DataFrame:
    kept = _first(stashes, max_stashes, "ref_name", "hash")
    prefix = F.concat(F.lit("Secret in Git Stash: [STASH "), "ref_name", F.lit("] "))
    contents = as_rows(
        kept.select("repo", "hash", "ref_name", F.inline(_secret_hits(F.col("diff")))).withColumn("file_path", _object_path(F.col("hash"))),
        _sec(F.col("line"), "Critical", F.concat(prefix, "kind"), "A stash holds a secret.",
             "Drop the stash and replace the secret.", "Hard", F.col("score"), F.col("hash"), reach="Stash"),
    )
    messages = as_rows(
        kept.filter(F.col("message").rlike(facts.STASH_WORDS)).withColumn("file_path", F.lit(".git/logs/refs/stash")),
        _sec(0, "Warning", "Sensitive Git Stash Message", F.concat("ref_name", F.lit(" names a secret.")),
             "Drop the stash.", "Easy", 65, F.col("hash"), reach="Stash"),
    )
    return contents.unionByName(messages)


def mask_url(url: Column) -> Column:
    """Address with its user and password hidden; port and fragment are dropped."""
    rx = r"^([A-Za-z][A-Za-z0-9+.-]*)://[^/@?#]+@([^/:?#]+)(?::\d+)?([^#]*)(#.*)?$"
    path = F.regexp_extract(url, rx, 3)
    masked = F.concat(
        F.lower(F.regexp_extract(url, rx, 1)), F.lit("://***:***@"), F.lower(F.regexp_extract(url, rx, 2)),
        F.when(path == "", "/").otherwise(path),
    )
    return F.when(url.rlike(rx), masked).otherwise(url)


def git_config_exposure(corpus: DataFrame) -> DataFrame:
    """Credentials and plain http in the remote addresses of git configurations."""
    path, line = F.col("file_path"), F.col("line")
    configs = corpus.filter(path.rlike(r"(^|/)\.git/config$"))
    urls = explode_lines(configs).filter(F.lower("line").contains("url = "))
    url = F.regexp_replace(F.regexp_extract("line", r"(?i)url\s*=\s*(.+)", 1), r"\s+$", "")
    credentials = as_rows(
        urls.filter(line.contains("://") & line.contains("@")),
        _sec(F.col("line_number"), "Critical", "Git Remote URL Contains Embedded Credentials",
             F.concat(F.lit("Remote "), mask_url(url), F.lit(" holds a password.")), "Use a credential helper.", "Easy", 100),
    )
    plain = as_rows(
        urls.filter(F.lower("line").contains("http://") & ~line.contains("localhost") & ~line.contains("127.0.0.1")),
        _sec(F.col("line_number"), "Warning", "Insecure HTTP Git Remote", "The remote is reached without encryption.", "Use https or ssh.", "Easy", 95),
    )
    return credentials.unionByName(plain)


def hook_forensics(corpus: DataFrame) -> DataFrame:
    hooks = corpus.filter(F.col("file_path").rlike(r"(^|/)\.git/hooks/[^/]+$")).withColumn("name", file_name(F.col("file_path")))
    odd = as_rows(
        hooks.filter(~F.lower("name").isin(facts.STANDARD_HOOKS)),
        _sec(0, "Warning", "Non-Standard Git Hook Detected", F.concat(F.lit("Hook "), "name", F.lit(" is not a known hook.")),
             "Review the hook.", "Easy", 70),
    )
    bad = as_rows(
        hooks.filter(F.lower("content").rlike(facts.HOOK_WORDS)),
        _sec(0, "Critical", F.concat(F.lit("Potentially Malicious Git Hook: "), "name"), "The hook reaches out or names a secret.",
             "Remove the hook unless it is yours.", "Easy", 90),
    )
    return odd.unionByName(bad)


def submodule_risks(corpus: DataFrame) -> DataFrame:
    modules = corpus.filter(F.col("file_path").rlike(r"(^|/)\.gitmodules$"))
    lines = explode_lines(modules).withColumn("low", F.lower("line"))
    low, n = F.col("low"), F.col("line_number")
    url = low.contains("url = ")
    parts = [
        (url & low.contains("http://"), _sec(n, "Warning", "Submodule Using Insecure HTTP", "The submodule is fetched without encryption.", "Use https or ssh.", "Easy", 90)),
        (url & low.contains("@") & low.contains("://"), _sec(n, "Critical", "Submodule URL Contains Embedded Credentials", "The address holds a password.", "Use a credential helper.", "Medium", 100)),
        (low.contains("path = .."), _sec(n, "Critical", "Submodule Path Traversal", "The path leaves the repository.", "Keep submodules inside.", "Easy", 100)),
    ]
    found = F.array_compact(F.array(*[F.when(cond, item) for cond, item in parts]))
    return lines.select("repo", "file_path", F.inline(found))


def entropy(token: Column) -> Column:
    """Shannon entropy of the characters, in bits per character."""
    def bits(t: Column) -> Column:
        n = F.length(t)
        return F.aggregate(
            F.array_distinct(F.split(t, "")),
            F.lit(0.0),
            lambda acc, c: let(
                F.length(t) - F.length(F.replace(t, c, F.lit(""))),
                lambda k: F.when((c == "") | (k == 0), acc).otherwise(acc - (k / n) * F.log2(k / n)),
            ),
        )

    return let(token, bits)


def _tokens() -> Column:
    """Long tokens of a file with line and bits, from ``content`` and ``ls``."""
    def on_line(l: Column, i: Column) -> Column:
        found = F.array_distinct(F.regexp_extract_all(l, F.lit(facts.TOKEN), F.lit(0)))
        return F.transform(
            found,
            lambda t: F.struct((i + 1).alias("line"), t.alias("token"), F.round(entropy(t), 6).alias("bits")),
        )

    kind = "array<struct<line:int,token:string,bits:double>>"
    tokens = F.flatten(F.transform("ls", on_line))
    return F.when(
        F.col("content").rlike(facts.TOKEN), F.filter(tokens, lambda t: t["bits"] >= facts.TOKEN_MIN_BITS)
    ).otherwise(F.array().cast(kind))


def _token_finding(t: Column) -> Column:
    why = F.concat(F.lit("A token carries "), F.format_number(t["bits"], 2), F.lit(" bits per character."))
    return finding(t["line"], "Warning", "Security", "High Entropy Token", why, "Check whether it is a key.", "Medium")


def entropy_findings() -> Column:
    return F.transform(_tokens(), _token_finding)


def high_entropy_tokens(files: DataFrame) -> DataFrame:
    """Long tokens whose characters are spread like those of random keys."""
    hits = with_lines(files).select("repo", "file_path", F.explode(_tokens()).alias("t"))
    rows = hits.select("repo", "file_path", _token_finding(F.col("t")).alias("f"), "t.token", "t.bits")
    return rows.select("repo", "file_path", "f.*", "token", "bits")


def signature_hits(content: Column) -> Column:
    """Vendor keys of a text: array of struct(line, name, value), the value as a hash."""
    def of_kind(l: Column, i: Column, name: str, pattern: str) -> Column:
        return F.transform(
            F.regexp_extract_all(l, F.lit(pattern), F.lit(0)),
            lambda m: F.struct((i + 1).alias("line"), F.lit(name).alias("name"), F.sha2(m, 256).alias("value")),
        )

    def hits(l: Column, i: Column) -> Column:
        return F.concat(*[of_kind(l, i, *entry) for entry in facts.HISTORY_SIGNATURES])

    maybe = content.rlike(r"AKIA|gh[pousr]_|xox|sk-|(?i:password|secret_key|api_key|token)")
    kind = "array<struct<line:int,name:string,value:string>>"
    return F.when(maybe, F.flatten(F.transform(split_lines(content), hits))).otherwise(F.array().cast(kind))


def object_secret_scan(objects: DataFrame) -> DataFrame:
    """Vendor keys anywhere in the objects, each value once with its first object: also objects of no commit."""
    found = objects.select("repo", "hash", "commit_time", F.inline(signature_hits(F.col("content"))))
    place = F.struct("commit_time", "hash", "line")
    once = found.groupBy("repo", "name", "value").agg(F.min(place).alias("p"), F.count("*").alias("uses"))
    rows = once.withColumn("file_path", _object_path(F.col("p.hash")))
    return rows.select(
        "repo", "file_path",
        _sec(F.col("p.line"), "Critical", F.concat(F.lit("Secret in Git History: "), "name"), "A key can still be read from history.",
             "Replace the key and rewrite history.", "Hard", 95, F.col("p.hash"), reach="History").alias("f"),
        "uses",
    ).select("repo", "file_path", "f.*", "uses")


def history_secret_scan(commits: DataFrame, changes: DataFrame, blobs: DataFrame, store: line_history.Store) -> DataFrame:
    """Vendor keys in the lines that commits added, each value once at its first commit by ancestry."""
    return line_history.history_secrets(commits, changes, blobs, signature_hits, store)


def large_pack_objects(objects: DataFrame, max_objects: int | None = None) -> DataFrame:
    big = _first(objects.filter(F.col("size_bytes") > facts.LARGE_OBJECT_BYTES), max_objects, "hash")
    mb = F.floor(F.col("size_bytes") / 1048576).cast("string")
    return as_rows(
        big.withColumn("file_path", F.lit(".git/objects/pack/")),
        _sec(0, "Info", "Large Object in Pack File", F.concat(F.lit("Object "), "hash", F.lit(" takes "), mb, F.lit(" MB.")),
             "Look at the object.", "Hard", 40, category="Structure"),
    )
