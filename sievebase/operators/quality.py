"""Code quality findings.

Functions that take no argument are file-local analyzers: columns over
``content`` and ``ls`` (its lines) giving ``array<finding>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievebase.functions.findings import as_rows, each_line, finding, when_all, with_lines
from sievebase.functions.substrings import first_path_holding
from sievebase.functions.text import MARK, file_name, first_lines, let, match_lines
from sievebase.operators.blocks import blocks
from sievebase.sources.corpus import language

# What counts as a method head, a branch and each smell.
MODIFIERS = "public|private|protected|internal|static|async|override|virtual|abstract|sealed"
METHOD = r"^(?:\s\s|\s?(?:" + MODIFIERS + r")+\s)\s*\w[\w<>\[\],\s\?]*\s(\w+)\s*\("
BRANCH = r"\b(if|else\s+if|for|foreach|while|do|switch|case|catch)\b|&&|\|\||\?[^?].*:"
EMPTY_CATCH = r"catch\s*(\([^)]*\))?\s*\{\s*\}"
STATIC_STATE = (
    r"(private|protected|internal)\s+(?:(?:static|readonly)\s+)?(?!const\s)"
    r"(List|Dictionary|Hashtable|Array|Queue|Stack|Set)\b"
)
SIGNATURE = r"(public|private|protected|internal)\s+\w[\w<>\[\],\s]*\s\w+\s*\("
BOOL_FIRST = r"\s*bool\s+\w"
LONG_PARAMETERS = r"[^)]{200,}\)"
LOCAL_TIME = r"\bDateTime\.Now\b(?!.*Utc)"
BLOCKING = r"\.(Result|Wait\(\))\s*;"
SLEEP = r"Thread\.Sleep\("
IMPORT = r"""#include\s*[<"]([^\s>"]+)|using\s+([\w\.]+)\b"""


# What stands between two brackets of other kinds: a signature begins and ends its name in one such run.
_RUN = r"[\w<>\[\],\s]"
_BEGIN = r"(?:public|private|protected|internal)\s+\w"


def signature_lines(content: Column, parameters: str, *needles: str) -> Column:
    """Lines where SIGNATURE begins, followed by ``parameters``, in time linear in the text.

    A run holds a match if and only if its first modifier begins one, as whatever follows a later modifier follows the first
    as well. So runs are tried at their start, or where the last match ended, and only at their first modifier.
    """
    pattern = rf"(?:(?<!{_RUN})|\G)((?:(?!{_BEGIN}){_RUN})*+)({SIGNATURE}{parameters})"
    return match_lines(content, pattern, *needles, marked="$1" + MARK + "$2")


def _quality(line, severity, title, why, advice, effort="Easy"):
    return finding(line, severity, "Quality", title, why, advice, effort)


def _each(numbers: Column, severity: str, title: str, why: str, advice: str, effort: str = "Easy") -> Column:
    return each_line(numbers, severity, "Quality", title, why, advice, effort)


def large_file_tiers() -> Column:
    n = F.size(F.col("ls"))
    why = F.concat(F.lit("The file has "), n.cast("string"), F.lit(" lines."))
    return when_all(
        (n > 1000, _quality(1, "Critical", "Massive File Detected", why, "Split the file by purpose.", "Hard")),
        ((n > 500) & (n <= 1000), _quality(1, "Warning", "Large File Detected", why, "Move related parts to files of their own.", "Medium")),
    )


def methods() -> Column:
    """Closed methods: name, first and last line, branches counted over their lines."""
    found = blocks(
        F.col("ls"),
        lambda l: F.regexp_extract(l, METHOD, 1),
        lambda l: F.regexp_count(l, F.lit(BRANCH)),
        closes_on_first_line=False,
    )
    return F.when(
        F.exists(F.col("ls"), lambda l: l.rlike(METHOD)), F.filter(found, lambda b: b["last"].isNotNull())
    ).otherwise(F.array().cast("array<struct<name:string,first:int,last:int,weight:int>>"))


def method_metrics(files: DataFrame) -> DataFrame:
    """Length and complexity of every method."""
    return with_lines(files).select("repo", "file_path", F.inline(methods())).select(
        "repo", "file_path", "name", F.col("first").alias("line_number"),
        (F.col("last") - F.col("first")).alias("length"), (F.col("weight") + 1).alias("complexity"),
    )


def method_findings() -> Column:
    def judge(b: Column) -> Column:
        length, complexity = b["last"] - b["first"], b["weight"] + 1
        size_why = F.concat(F.lit("Method "), b["name"], F.lit(" has "), length.cast("string"), F.lit(" lines."))
        branch_why = F.concat(F.lit("Method "), b["name"], F.lit(" has complexity "), complexity.cast("string"), F.lit("."))
        return when_all(
            (length > 100, _quality(b["first"], "Critical", "God Method Detected", size_why, "Extract parts into methods.", "Hard")),
            ((length > 50) & (length <= 100), _quality(b["first"], "Warning", "Long Method Detected", size_why, "Extract parts into methods.", "Medium")),
            (complexity > 20, _quality(b["first"], "Critical", "Extreme Cyclomatic Complexity", branch_why, "Split the decisions over several methods.", "Hard")),
            ((complexity > 10) & (complexity <= 20), _quality(b["first"], "Warning", "High Cyclomatic Complexity", branch_why, "Simplify the decisions.", "Medium")),
        )

    return F.flatten(F.transform(methods(), judge))


def deep_nesting(deepest: Column, at: Column) -> Column:
    why = F.concat(F.lit("Braces nest "), deepest.cast("string"), F.lit(" levels deep."))
    return _quality(at, "Warning", "Deep Nesting Detected", why, "Return early or extract the inner part.", "Medium")


def nesting_depth() -> Column:
    """Deepest brace level and the line where it is first reached."""
    state = "struct<depth:int,line:int,deepest:int,at:int>"

    def step(acc: Column, token: Column) -> Column:
        depth = acc["depth"] + F.when(token == "{", 1).when(token == "}", -1).otherwise(0)
        deeper = depth > acc["deepest"]
        return F.struct(
            depth.alias("depth"),
            (acc["line"] + F.when(token == "\n", 1).otherwise(0)).alias("line"),
            F.greatest(depth, acc["deepest"]).alias("deepest"),
            F.when(deeper, acc["line"]).otherwise(acc["at"]).alias("at"),
        ).cast(state)

    start = F.struct(F.lit(0).alias("depth"), F.lit(1).alias("line"), F.lit(0).alias("deepest"), F.lit(0).alias("at"))
    tokens = F.when(F.col("content").rlike(r"(?s)^(?:[^{]*\{){5}"), F.regexp_extract_all(F.col("content"), F.lit(r"[{}\n]"), F.lit(0)))
    deepest = F.aggregate(F.coalesce(tokens, F.array().cast("array<string>")), start.cast(state), step)
    return let(
        deepest,
        lambda d: when_all(
            (
                d["deepest"] >= 5,
                deep_nesting(d["deepest"], d["at"]),
            )
        ),
    )


def empty_catch() -> Column:
    return _each(match_lines(F.col("content"), EMPTY_CATCH, "catch"), "Warning", "Empty Exception Handler",
                 "Errors vanish without a trace.", "Log the error or let it pass.")


def console_output() -> Column:
    def printed(start: str, title: str) -> Column:
        own_code = ~F.lower(F.col("file_path")).contains("test") & ~F.lower(F.col("file_path")).contains("spec") & F.col("content").contains(start)
        hit = F.transform(F.col("ls"), lambda l: F.regexp_replace(l, r"^\s+", "").startswith(start))
        lines = F.when(own_code, first_lines(hit)).otherwise(F.array().cast("array<int>"))
        return _each(lines, "Info", title, "Console output is left in production code.", "Write to a logger.")

    return F.concat(
        printed("Console.WriteLine(", "Console.WriteLine in Production"),
        printed("System.out.println(", "System.out.println in Production"),
    )


def commented_code_blocks() -> Column:
    """Three comment lines in a row, reported where the line before is not ``//``.

    Runs of ``#`` lines are therefore reported on each of their starts.
    """
    python = language(F.col("file_path")) == "Python"
    kind = F.transform(
        F.col("ls"),
        lambda l: F.when(l.rlike(r"^\s*//"), 2).when(python & l.rlike(r"^\s*#"), 1).otherwise(0),
    )
    starts = let(
        kind,
        lambda k: first_lines(
            F.transform(
                k,
                lambda x, i: (x > 0)
                & (F.get(k, i + 1) == x)
                & (F.get(k, i + 2) == x)
                & ((i == 0) | (F.coalesce(F.get(k, i - 1), F.lit(0)) != 2)),
            )
        ),
    )
    any_comment = F.col("content").contains("//") | (python & F.col("content").contains("#"))
    return _each(F.when(any_comment, starts).otherwise(F.array().cast("array<int>")), "Info",
                 "Commented Out Code Block", "Code is kept as comments.", "Delete it; history keeps it.")


def static_mutable_state() -> Column:
    return _each(
        match_lines(F.col("content"), STATIC_STATE, "private", "protected", "internal"),
        "Critical", "Static Mutable State Detected", "A shared collection can change under its users.",
        "Use a thread-safe collection or instance state.", "Medium",
    )


def bool_param_trap() -> Column:
    return _each(signature_lines(F.col("content"), BOOL_FIRST, "bool"), "Warning", "Boolean Parameter Trap",
                 "Callers pass a bare true or false.", "Use a named value or an enumeration.")


def local_time_usage() -> Column:
    return _each(match_lines(F.col("content"), LOCAL_TIME, "DateTime.Now"), "Warning", "DateTime.Now Instead of DateTime.UtcNow",
                 "Local time differs between machines.", "Take the time in UTC.")


def task_blocking() -> Column:
    return _each(match_lines(F.col("content"), BLOCKING, ".Result", ".Wait()"), "Warning", "Synchronous Task Blocking (.Result/.Wait())",
                 "The thread waits for a task.", "Await the task.", "Medium")


def thread_sleep() -> Column:
    return _each(match_lines(F.col("content"), SLEEP, "Thread.Sleep("), "Warning", "Thread.Sleep in Async Code",
                 "The thread is held while waiting.", "Await a delay.")


def long_param_list() -> Column:
    return _each(signature_lines(F.col("content"), LONG_PARAMETERS, "("), "Info", "Method Has Too Many Parameters",
                 "The parameter list is very long.", "Group the parameters.")


FILE_LOCAL = (
    large_file_tiers, method_findings, nesting_depth, empty_catch, console_output, commented_code_blocks,
    static_mutable_state, bool_param_trap, local_time_usage, task_blocking, thread_sleep, long_param_list,
)


PLACES_NAMED = 3


def duplicate_blocks(files: DataFrame, size: int = 8, per_repo: int | None = None) -> DataFrame:
    """Identical line windows in two or more files of a repository; all of them unless ``per_repo`` is given.

    Only a 128-bit digest per window leaves the file. Windows are reduced to one
    row per (repo, digest, file); then counts are partial sums, and the places that
    the text names (``PLACES_NAMED``) are cut per partition before their shuffle,
    so a block that most files share costs a few rows per task.
    """
    clean = F.transform(F.col("ls"), lambda l: F.lower(F.regexp_replace(l, r"^\s+|\s+$", "")))

    def window(rows: Column, i: Column) -> Column:
        return let(
            F.btrim(F.array_join(F.slice(rows, i, size), "\n"), F.lit("\n")),
            lambda text: F.when(
                F.length(text) >= 40, F.struct(i.alias("line"), F.unhex(F.md5(text)).alias("digest"))
            ),
        )

    windows = let(
        clean,
        lambda rows: F.when(
            F.size(rows) >= size,
            F.array_compact(F.transform(F.sequence(F.lit(1), F.size(rows) - (size - 1)), lambda i: window(rows, i))),
        ),
    )
    seen = (
        with_lines(files)
        .select("repo", "file_path", F.inline(windows))
        # Stated here so that both uses below are the same plan and share one shuffle.
        .filter(F.col("repo").isNotNull() & F.col("digest").isNotNull())
        .groupBy("repo", "digest", "file_path")
        .agg(F.min("line").alias("line"))
    )
    first_place = F.struct("file_path", "line")
    shared = seen.groupBy("repo", "digest").agg(
        F.count("*").alias("file_count"), F.min(first_place).alias("first")
    ).filter(F.col("file_count") >= 2)
    if per_repo is not None:
        order = Window.partitionBy("repo").orderBy("first")
        shared = shared.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= per_repo)
    nearest = Window.partitionBy("repo", "digest").orderBy("file_path")
    named = (
        seen.withColumn("n", F.row_number().over(nearest))
        .filter(F.col("n") <= PLACES_NAMED)
        .groupBy("repo", "digest")
        .agg(F.sort_array(F.collect_list(F.struct("file_path", "line"))).alias("places"))
    )
    places = shared.join(named, ["repo", "digest"])
    where = F.array_join(
        F.transform("places", lambda p: F.concat(p["file_path"], F.lit(":"), p["line"].cast("string"))), ", "
    )
    return places.select(
        "repo", F.col("first.file_path").alias("file_path"), "file_count",
        _quality(F.col("first.line"), "Warning", "Duplicate Code Block",
                 F.concat(F.lit(f"The same {size} lines are at: "), where),
                 "Share the code from one place.", "Medium").alias("f"),
    ).select("repo", "file_path", "f.*", "file_count")


def imports(files: DataFrame) -> DataFrame:
    """Import targets of each file, distinct ignoring case, with first position."""
    found = F.regexp_extract_all(F.col("content"), F.lit(IMPORT), F.lit(0))
    target = F.transform(found, lambda m: F.regexp_replace(m, r"""^(#include\s*[<"]|using\s+)""", ""))
    return (
        files.filter(F.col("content").contains("using") | F.col("content").contains("#include"))
        .select("repo", "file_path", F.posexplode(target).alias("pos", "target"))
        .filter(F.col("target") != "")
        .groupBy("repo", "file_path", F.lower("target").alias("target"))
        .agg(F.min("pos").alias("pos"))
    )


def circular_imports(files: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """Files whose import leads to a file that imports them back.

    An import points to the first path (by name) that holds its text. ``found``
    may give the stored import table, which is read several times.
    """
    found = imports(files) if found is None else found
    resolved = first_path_holding(found, files)
    back = found.select("repo", F.col("file_path").alias("dest"), F.col("target").alias("back"))
    place = F.struct("pos", "dest")
    loops = (
        found.join(resolved, ["repo", "target"])
        .join(back, ["repo", "dest"])
        .filter(F.contains(F.lower("file_path"), F.col("back")))
        .groupBy("repo", "file_path")
        .agg(F.min(place)["dest"].alias("dest"))
    )
    why = F.concat(F.lit("Import loop between "), file_name(F.col("file_path")), F.lit(" and "), file_name(F.col("dest")), F.lit("."))
    return as_rows(
        loops,
        _quality(1, "Critical", "Circular Dependency Detected", why, "Depend on a shared interface.", "Hard"),
    )
