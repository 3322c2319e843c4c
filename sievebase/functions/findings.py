"""The findings table: one schema shared by every analyzer.

File-local analyzers are column expressions giving ``array<finding>``, so any
number of them run over a file in one projection and one scan, with no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievebase.functions.text import split_lines, sql_value

FINDING = T.StructType(
    [
        T.StructField("line_number", T.IntegerType()),
        T.StructField("severity", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("suggestion", T.StringType()),
        T.StructField("effort_level", T.StringType()),
        T.StructField("confidence_score", T.IntegerType()),
        T.StructField("data_flow_trace", T.StringType()),
        T.StructField("commit_hash", T.StringType()),
        T.StructField("commit_date", T.StringType()),
        T.StructField("reachability_status", T.StringType()),
    ]
)
KEYS = ["repo", "file_path"]
COLUMNS = KEYS + FINDING.fieldNames()
CORE = KEYS + [
    "line_number", "severity", "category", "title", "effort_level", "confidence_score",
]


def _text(value: str | Column | None) -> Column:
    if isinstance(value, Column):
        return value
    return F.expr("cast(null as string)") if value is None else F.lit(value)


def finding(
    line: Column | int,
    severity: str | Column,
    category: str,
    title: str | Column,
    description: str | Column,
    suggestion: str | Column,
    effort: str | Column = "Easy",
    confidence: int | Column = 0,
    trace: Column | None = None,
    commit: Column | None = None,
    commit_date: Column | None = None,
    reach: str | None = None,
) -> Column:
    """One finding as a struct; score 0 means "not scored yet"."""
    number = line if isinstance(line, Column) else F.lit(line)
    score = confidence if isinstance(confidence, Column) else F.lit(confidence)
    return F.struct(
        number.cast("int").alias("line_number"),
        _text(severity).alias("severity"),
        _text(category).alias("category"),
        _text(title).alias("title"),
        _text(description).alias("description"),
        _text(suggestion).alias("suggestion"),
        _text(effort).alias("effort_level"),
        score.cast("int").alias("confidence_score"),
        _text(trace).alias("data_flow_trace"),
        _text(commit).alias("commit_hash"),
        _text(commit_date).alias("commit_date"),
        _text(reach).alias("reachability_status"),
    )


def each_line(
    numbers: Column, severity: str, category: str, title: str, description: str, suggestion: str, effort: str = "Easy"
) -> Column:
    """One finding with constant texts per line number of an array.

    Written as one SQL lambda: building it field by field from Python would take
    longer than planning the query.
    """
    texts = {"severity": severity, "category": category, "title": title, "description": description,
             "suggestion": suggestion, "effort_level": effort}
    constants = ", ".join(f"'{name}', {sql_value(text)}" for name, text in texts.items())
    nulls = ", ".join(f"'{name}', cast(null as string)" for name in FINDING.fieldNames()[8:])
    body = f"named_struct('line_number', n, {constants}, 'confidence_score', 0, {nulls})"
    return F.call_function("transform", numbers, F.expr(f"n -> {body}"))


def no_findings() -> Column:
    return F.array().cast(f"array<{FINDING.simpleString()}>")


def when_all(*pairs: tuple[Column, Column]) -> Column:
    """Array of the findings whose condition holds."""
    return F.array_compact(F.array(*[F.when(cond, item) for cond, item in pairs]))


def with_lines(files: DataFrame) -> DataFrame:
    """Files with their lines as the array column ``ls``."""
    return files.withColumn("ls", split_lines(F.col("content")))


def emit(files: DataFrame, *analyzers) -> DataFrame:
    """Findings of any number of file-local analyzers in one pass over the files."""
    return with_lines(files).select(*KEYS, F.inline(F.concat(*[a() for a in analyzers])))


def as_rows(df: DataFrame, item: Column) -> DataFrame:
    """One finding per input row."""
    return df.select(*KEYS, item.alias("f")).select(*KEYS, "f.*")
