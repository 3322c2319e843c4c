"""Repository structure and hygiene findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievebase.functions.findings import as_rows, finding, no_findings, when_all
from sievebase.functions.substrings import first_path_holding
from sievebase.functions.text import extension, file_name, first_lines, split_lines

# Path marks of build pipelines and extensions of dumps and scripts.
PIPELINE_MARKS = [".github/workflows", ".gitlab-ci", ".travis.yml", "Jenkinsfile", "azure-pipelines", ".circleci"]
DUMP_EXTENSIONS = [".sql", ".dump", ".backup", ".bak"]
SCRIPT_EXTENSIONS = [".sh", ".bash", ".zsh", ".py", ".rb", ".pl"]
OLD_CHECKOUTS = ["uses: actions/checkout@v1", "uses: actions/checkout@v2", "uses: actions/checkout@v3"]
PINNED_HEAD = "ref: ${{ github.event.pull_request.head.sha }}"


def _structure(line, severity, title, why, advice, effort="Easy"):
    return finding(line, severity, "Structure", title, why, advice, effort)


def _path() -> Column:
    return F.col("file_path")


def repo_presence_checks(files: DataFrame) -> DataFrame:
    """What a repository lacks; paths only are read and reduced before the shuffle."""
    low = F.lower("file_path")
    marks = None
    for mark in PIPELINE_MARKS:
        marks = _path().contains(mark) if marks is None else marks | _path().contains(mark)
    has = files.groupBy("repo").agg(
        F.bool_or(low.endswith(".gitignore")).alias("ignore"),
        F.bool_or(low.endswith("readme.md") | low.endswith("readme.txt") | low.endswith("readme")).alias("readme"),
        F.bool_or(low.contains("test") | low.contains("spec")).alias("tests"),
        F.bool_or(marks).alias("pipeline"),
        F.bool_or(low.contains("license") | low.contains("licence")).alias("licence"),
    )
    missing = [
        ("ignore", ".gitignore", "Warning", "No .gitignore File", "Local files may be committed.", "Add an ignore file."),
        ("readme", "README.md", "Info", "No README Found", "Nothing explains the repository.", "Add a readme."),
        ("tests", "", "Info", "No Tests Detected", "No path names a test.", "Add tests."),
        ("pipeline", "", "Info", "No CI/CD Configuration", "No build pipeline is set up.", "Set up a pipeline."),
        ("licence", "LICENSE", "Info", "No License File", "Terms of use are not stated.", "Add a licence."),
    ]
    rows = F.array_compact(
        F.array(
            *[
                F.when(
                    ~F.col(flag),
                    F.struct(F.lit(path).alias("file_path"), _structure(0, sev, title, why, advice).alias("f")),
                )
                for flag, path, sev, title, why, advice in missing
            ]
        )
    )
    return has.select("repo", F.inline(rows)).select("repo", "file_path", "f.*")


def env_files(files: DataFrame) -> DataFrame:
    """Environment files, with the repository's first ignore file taken into account."""
    ignore = (
        files.filter(_path().endswith(".gitignore"))
        .groupBy("repo")
        .agg(F.min_by(F.col("content").contains(".env"), "file_path").alias("ignored"))
    )
    name = file_name(_path())
    env = files.filter(name.startswith(".env")).select("repo", "file_path").join(ignore, "repo", "left")
    found = when_all(
        (~F.coalesce("ignored", F.lit(False)),
         _structure(1, "Warning", "Secrets File May Be Committed", F.concat(name, F.lit(" is not ignored.")), "Ignore it and replace its secrets.")),
        (name.isin(".env.production", ".env.local"),
         _structure(1, "Warning", "Environment-Specific Secrets File", F.concat(name, F.lit(" belongs to one environment.")), "Keep it outside the repository.")),
        (F.lit(True),
         _structure(1, "Critical", "Environment File Committed", F.concat(name, F.lit(" is tracked.")), "Stop tracking it and replace its secrets.")),
    )
    return env.select("repo", "file_path", F.inline(found))


def oversize_and_binary(listing: DataFrame) -> DataFrame:
    """Large files and executables; the unfiltered listing, since the walk drops both."""
    size_kb = F.bround(F.col("size_bytes") / 1024.0, 2)
    found = when_all(
        (size_kb > 1024, _structure(1, "Warning", "Large File Committed", "The file is over one megabyte.", "Use large file storage.")),
        (extension(_path()).isin(".exe", ".dll"),
         _structure(1, "Warning", "Binary Executable Committed", "Build output is tracked.", "Ignore it and stop tracking it.")),
    )
    return listing.select("repo", "file_path", F.inline(found))


def deep_paths(files: DataFrame, depth: int = 7) -> DataFrame:
    """The first file of a repository that lies seven or more names deep."""
    deep = files.filter(F.size(F.split("file_path", "/")) >= depth).groupBy("repo").agg(F.min("file_path").alias("file_path"))
    why = F.concat(F.lit("The path has "), F.size(F.split("file_path", "/")).cast("string"), F.lit(" names."))
    return as_rows(deep, _structure(0, "Info", "Deeply Nested Directory Structure", why, "Flatten the folders."))


def merge_markers() -> Column:
    return when_all(
        (F.col("content").rlike(r"(^|\n)[<>=]{7}"),
         _structure(1, "Warning", "Merge Conflict Markers Left in Code", "A conflict was committed unresolved.", "Resolve it and remove the markers."))
    )


def ineffective_gitignore(files: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """The first ignore pattern of a repository that still matches a tracked path.

    ``paths`` lists the tracked files if ``files`` holds ignore files only.
    """
    paths = files if paths is None else paths
    first = (
        files.filter(_path().endswith(".gitignore"))
        .groupBy("repo")
        .agg(F.min_by("content", "file_path").alias("content"))
        .filter(F.col("content") != "")
    )
    patterns = (
        first.select("repo", F.posexplode(split_lines(F.col("content"))).alias("pos", "pattern"))
        .withColumn("pattern", F.regexp_replace("pattern", r"^\s+|\s+$", ""))
        .filter((F.col("pattern") != "") & ~F.col("pattern").startswith("#"))
        .withColumn("target", F.regexp_replace("pattern", r"^/+|[*/]+$", ""))
    )
    held = first_path_holding(patterns.filter(F.col("target") != ""), paths)
    # An empty target is part of every path.
    hits = (
        patterns.join(held, ["repo", "target"], "left")
        .filter(F.col("dest").isNotNull() | (F.col("target") == ""))
        .groupBy("repo")
        .agg(F.min_by("pattern", "pos").alias("pattern"))
        .withColumn("file_path", F.lit(".gitignore"))
    )
    return as_rows(
        hits,
        _structure(
            0, "Info", F.concat(F.lit(".gitignore Pattern Ineffective: "), "pattern"),
            "The pattern matches tracked files; it holds for untracked ones only.", "Stop tracking the matching files.",
        ),
    )


def committed_artifacts(files: DataFrame) -> DataFrame:
    path = _path()
    log = path.endswith(".log") | path.endswith("_log.txt") | path.contains("/logs/")
    dump = extension(path).isin(DUMP_EXTENSIONS) | path.endswith(".db") | path.endswith(".sqlite")
    found = when_all(
        (log, _structure(1, "Warning", "Log File Committed to Repository", "Logs are tracked.", "Ignore logs.")),
        (dump, _structure(1, "Critical", "Database Dump Committed", "A dump may hold real data.", "Remove it from history.", "Hard")),
    )
    artifacts = files.select("repo", "file_path", F.inline(found))
    message = files.filter(path.endswith("COMMIT_EDITMSG")).groupBy("repo").agg(F.min("file_path").alias("file_path"))
    return artifacts.unionByName(
        as_rows(message, _structure(1, "Warning", "Git Editor Message File Committed", "A draft message is tracked.", "Remove and ignore it."))
    )


def missing_shebang() -> Column:
    return when_all(
        (F.lower(extension(_path())).isin(SCRIPT_EXTENSIONS) & ~F.col("content").startswith("#!"),
         _structure(1, "Info", "Script Missing Shebang Line", "The interpreter is not named.", "Name it on the first line."))
    )


def todo_first_per_file() -> Column:
    """The first comment line with an open task; the whole file is searched."""
    hits = first_lines(F.transform(F.col("ls"), lambda l: l.rlike(r"(?i)todo") & l.rlike(r"^\s*(//|#|/\*)")))
    first = F.when(F.col("content").rlike("(?i)todo"), F.array_min(hits))
    return F.when(
        first.isNotNull(),
        F.array(_structure(first, "Info", "TODO Comment in Source", "Work is left open.", "Finish it or open a ticket.")),
    ).otherwise(no_findings())


def workflow_checks() -> Column:
    content = F.col("content")
    workflow = _path().contains(".github/workflows/") & extension(_path()).isin(".yml", ".yaml")
    old = None
    for mark in OLD_CHECKOUTS:
        old = content.contains(mark) if old is None else old | content.contains(mark)
    target = content.contains("on: [pull_request_target]") | content.contains("on:\n  pull_request_target:")
    return when_all(
        (workflow & old, _structure(1, "Warning", "Outdated GitHub Action Version", "An old checkout action is used.", "Move to the current version.")),
        (workflow & target & content.contains("actions/checkout") & ~content.contains(PINNED_HEAD),
         _structure(1, "Critical", "Insecure pull_request_target checkout", "Foreign code may run with write access.", "Use the plain pull request event.", "Medium")),
    )


FILE_LOCAL = (merge_markers, missing_shebang, todo_first_per_file, workflow_checks)
FILE_OPS = (repo_presence_checks, env_files, deep_paths, ineffective_gitignore, committed_artifacts)
