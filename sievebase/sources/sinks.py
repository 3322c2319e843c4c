"""Writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievebase.operators import history


def write_findings(findings: DataFrame, path: str) -> None:
    """Findings as parquet by category and severity, columns later reads select on."""
    findings.write.mode("overwrite").partitionBy("category", "severity").parquet(path)


def write_csv_reports(issues: DataFrame, path: str) -> None:
    """Report lines as CSV text. Every file starts with the header."""
    lines = history.findings_csv_export(issues)
    names = history.CSV_HEADER.split(",")
    # The lines are quoted already; as one unquoted column they are written as they are.
    lines.select(F.col("csv_line").alias(",".join(names))).write.mode("overwrite").option("header", True).option(
        "quote", "\u0000"
    ).option("escapeQuotes", False).option("sep", "\u0001").csv(path)


def write_user_exports(scans: DataFrame, path: str) -> None:
    """One JSON line per scan with its user and the user's count, newest first."""
    export = history.user_export(scans)
    line = F.to_json(
        F.struct("user_id", "total_scans", F.from_json("scan_json", "map<string,string>").alias("scan"))
    )
    export.select(line.alias("value")).write.mode("overwrite").text(path)


def write_fix_bundles(bundle: DataFrame, path: str) -> None:
    """Fix texts in rule and file order as text."""
    ordered = bundle.orderBy("title", "repo", "file_path", "line_number")
    ordered.select(F.concat("title", F.lit("\n"), "fix_text").alias("value")).write.mode("overwrite").text(path)
