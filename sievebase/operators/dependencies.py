"""Dependency findings from manifest files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievebase.functions.findings import as_rows, finding
from sievebase.functions.text import constant_table, explode_lines, extension, file_name
from sievebase.functions.versions import older
from sievebase.rules import advisories


def _dep(line, severity, title, why, advice):
    return finding(line, severity, "Dependency", title, why, advice)


def _named(files: DataFrame, *names: str) -> DataFrame:
    """Lines of the manifests with these names; only their text is read on."""
    return explode_lines(files.filter(F.lower(file_name(F.col("file_path"))).isin(*names)))


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def missing_lockfile(files: DataFrame) -> DataFrame:
    """Repositories with a manifest and no lock file; paths only are read."""
    low = F.lower("file_path")
    per_repo = files.groupBy("repo").agg(
        F.min(F.when(low.endswith("package.json"), F.col("file_path"))).alias("npm"),
        F.bool_or(low.contains("lock")).alias("any_lock"),
        F.min(F.when(low.endswith("requirements.txt"), F.col("file_path"))).alias("python"),
        F.bool_or(low.endswith("requirements.lock")).alias("python_lock"),
    )
    npm = as_rows(
        per_repo.filter(F.col("npm").isNotNull() & ~F.col("any_lock")).withColumn("file_path", F.col("npm")),
        _dep(1, "Warning", "No Lockfile Found (npm)", "Package versions are not pinned.", "Commit a lock file."),
    )
    python = as_rows(
        per_repo.filter(F.col("python").isNotNull() & ~F.col("python_lock")).withColumn("file_path", F.col("python")),
        _dep(1, "Warning", "No Lockfile Found (Python)", "Package versions are not pinned.", "Commit a lock file."),
    )
    return npm.unionByName(python)


def duplicate_json_keys(files: DataFrame) -> DataFrame:
    """Keys found on more than one line of a package.json."""
    key = F.regexp_extract("line", r'"([\w\-@/]+)"\s*:', 1)
    dup = (
        _named(files, "package.json").withColumn("key", key).filter(F.col("key") != "")
        .groupBy("repo", "file_path", "key")
        .agg(F.min("line_number").alias("line_number"), F.count("*").alias("n"))
        .filter(F.col("n") > 1)
    )
    why = F.concat(F.lit("Key "), "key", F.lit(" is on "), F.col("n").cast("string"), F.lit(" lines."))
    return as_rows(
        dup, _dep(F.col("line_number"), "Warning", F.concat(F.lit("Duplicate Package: "), "key"), why, "Keep one entry.")
    )


PYTHON_MANIFESTS = ("requirements.txt", "pipfile", "pyproject.toml")


def _python_lines(files: DataFrame) -> DataFrame:
    lines = _named(files, *PYTHON_MANIFESTS).withColumn("line", _trim(F.col("line")))
    return lines.filter((F.col("line") != "") & ~F.col("line").startswith("#"))


def wildcard_versions(files: DataFrame) -> DataFrame:
    npm = as_rows(
        _named(files, "package.json").filter(F.col("line").contains('"*"')),
        _dep(F.col("line_number"), "Warning", "Wildcard Version Dependency", "Any version is accepted.", "Name a version range."),
    )
    python = as_rows(
        _python_lines(files).filter(F.col("line").contains("*") | F.col("line").contains("latest")),
        _dep(F.col("line_number"), "Warning", "Unpinned/Wildcard Dependency Version", "Any version is accepted.", "Name a version."),
    )
    return npm.unionByName(python)


def _vulnerable(lines: DataFrame, table: list[tuple], names_package, version: Column) -> DataFrame:
    """Lines naming a package of a constant table with a version below the safe one."""
    known = constant_table(
        [(p, p.lower(), safe, sev, cve, why) for p, safe, sev, cve, why in table],
        ["package", "low", "safe", "severity", "cve", "why"],
    )
    hits = (
        lines.withColumn("version", version)
        .filter(F.col("version") != "")
        .withColumn("low", F.lower("line"))
        .select(
            "repo", "file_path", "line_number", "version",
            F.explode(F.filter(known, lambda k: names_package(F.col("low"), k["low"]))).alias("k"),
        )
        .filter(older(F.col("version"), F.col("k.safe")))
    )
    why = F.concat("k.why", F.lit("; safe from "), "k.safe", F.lit("."))
    return as_rows(
        hits,
        _dep(
            F.col("line_number"), F.col("k.severity"),
            F.concat(F.lit("Vulnerable: "), "k.package", F.lit(" "), "version"), why,
            F.concat(F.lit("Move "), "k.package", F.lit(" to "), "k.safe", F.lit(" or later.")),
        ),
    )


# How each kind of manifest writes a version.
NPM_VERSION = r'"[~^>=<]*(\d+\.\d+[\.\d]*)"'
PYTHON_VERSION = r"[><=~!]+\s*(\d+\.\d+[\.\d]*)"
DOTNET_VERSION = r'Version\s*=\s*"(\d+\.\d+[\.\d]*)"'


def vulnerable_npm(files: DataFrame) -> DataFrame:
    version = F.regexp_extract("line", NPM_VERSION, 1)
    return _vulnerable(
        _named(files, "package.json"), advisories.NPM,
        lambda low, p: F.contains(low, F.concat(F.lit('"'), p, F.lit('"'))), version,
    )


def vulnerable_python(files: DataFrame) -> DataFrame:
    """The line starts with the name, so longer names with that start count too."""
    version = F.regexp_extract("line", PYTHON_VERSION, 1)
    return _vulnerable(_python_lines(files), advisories.PYTHON, lambda low, p: F.startswith(low, p), version)


def _project_lines(files: DataFrame) -> DataFrame:
    named = PYTHON_MANIFESTS + ("package.json",)
    projects = files.filter(
        (extension(F.col("file_path")) == ".csproj") & ~F.lower(file_name(F.col("file_path"))).isin(*named)
    )
    return explode_lines(projects).filter(F.col("line").contains("PackageReference"))


def manifest_lines(files: DataFrame) -> DataFrame:
    """The lines that may name a dependency, with their ecosystem."""
    kinds = (("npm", _named(files, "package.json")), ("python", _python_lines(files)), ("dotnet", _project_lines(files)))
    parts = [lines.select(F.lit(kind).alias("ecosystem"), "repo", "file_path", "line_number", "line") for kind, lines in kinds]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def vulnerable_dotnet(files: DataFrame) -> DataFrame:
    lines, version = _project_lines(files), F.regexp_extract("line", DOTNET_VERSION, 1)
    return _vulnerable(lines, advisories.DOTNET, lambda low, p: F.contains(low, p), version)


def unpinned_other(files: DataFrame) -> DataFrame:
    line, n = F.col("line"), F.col("line_number")
    gems = as_rows(
        _named(files, "gemfile").filter(line.contains("gem ") & ~line.contains("~>") & ~line.contains("',")),
        _dep(n, "Warning", "Unpinned Ruby Gem", "The gem names no version.", "Name a version range."),
    )
    modules = as_rows(
        _named(files, "go.mod").filter(line.contains("v0.0.0-") | line.contains("+incompatible")),
        _dep(n, "Info", "Go Pseudo-version or Incompatible Module", "The module is not a release.", "Move to a release."),
    )
    poms = as_rows(
        _named(files, "pom.xml").filter(line.contains("<version>") & line.contains("SNAPSHOT")),
        _dep(n, "Warning", "SNAPSHOT Dependency in POM", "Snapshots change over time.", "Use a release."),
    )
    return gems.unionByName(modules).unionByName(poms)


def advisory_staleness(files: DataFrame, as_of: str) -> DataFrame:
    """Repositories whose manifests are judged by a rule set older than 90 days."""
    name = F.lower(file_name(F.col("file_path")))
    kind = (
        F.when(name == "package.json", "npm").when(name.isin(*PYTHON_MANIFESTS), "python")
        .when(extension(F.col("file_path")) == ".csproj", "dotnet")
    )
    updated = constant_table(list(advisories.LAST_UPDATED.items()), ["rule_set", "updated"])
    age = F.datediff(F.lit(as_of).cast("date"), F.col("u.updated").cast("date"))
    return (
        files.select("repo", kind.alias("rule_set")).filter(F.col("rule_set").isNotNull())
        .groupBy("repo", "rule_set").agg(F.count("*").alias("manifests"))
        .withColumn("u", F.explode(updated))
        .filter((F.col("u.rule_set") == F.col("rule_set")) & (age > advisories.STALE_AFTER_DAYS))
        .select("repo", "rule_set", "manifests", F.col("u.updated").alias("last_updated"), age.alias("age_days"))
    )


MANIFEST_OPS = (
    duplicate_json_keys, wildcard_versions, vulnerable_npm, vulnerable_python, vulnerable_dotnet, unpinned_other,
)
FILE_OPS = (missing_lockfile, *MANIFEST_OPS)
