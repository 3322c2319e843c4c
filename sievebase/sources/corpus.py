"""Preparing the file corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievebase.functions.text import constant_map, extension, file_name, split_lines
from sievebase.rules import vocabulary as vocab
from sievebase.session import materialize


def skip_reason(path: Column, size_bytes: Column, max_bytes: int | None = vocab.MAX_FILE_BYTES) -> Column:
    """Why the walk leaves a file out; null when it is kept."""
    low = F.lower(path)
    folders = F.slice(F.split(low, "/"), 1, F.size(F.split(low, "/")) - 1)
    skipped_dirs = F.array(*[F.lit(d) for d in vocab.SKIPPED_DIRECTORIES])
    reason = (
        F.when(F.arrays_overlap(folders, skipped_dirs), "directory")
        .when(low.endswith(".min.js") | low.endswith(".min.css"), "minified")
        .when(extension(low).isin(vocab.SKIPPED_EXTENSIONS), "extension")
    )
    return reason if max_bytes is None else reason.when(size_bytes > max_bytes, "size")


def with_skip_reason(listing: DataFrame) -> DataFrame:
    return listing.withColumn("skip_reason", skip_reason(F.col("file_path"), F.col("size_bytes")))


def kept_files(corpus: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """The files the analyzers see: of any size unless ``max_bytes`` is given."""
    reason = skip_reason(F.col("file_path"), F.octet_length("content"), max_bytes)
    return corpus.filter(reason.isNull()).select("repo", "file_path", "content")


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(constant_map(table), key)


def language(path: Column) -> Column:
    """Language by special file name, then by extension, else ``Other``."""
    name = F.lower(file_name(path))
    return F.coalesce(
        F.when(name.startswith("dockerfile."), "Docker"),
        _lookup(vocab.LANGUAGE_BY_NAME, name),
        _lookup(vocab.LANGUAGE_BY_EXTENSION, F.lower(extension(path))),
        F.lit("Other"),
    )


def describe_files(listing: DataFrame) -> DataFrame:
    """Per file: extension, size in KB and number of lines."""
    return listing.select(
        "repo", "file_path",
        extension(F.col("file_path")).alias("extension"),
        F.bround(F.col("size_bytes") / 1024.0, 2).alias("size_kb"),
        F.size(split_lines(F.col("content"))).alias("line_count"),
    )


def classify_languages(listing: DataFrame) -> DataFrame:
    return listing.select("repo", "file_path", language(F.col("file_path")).alias("language"))


def corpus_stats(listing: DataFrame, top: int = 5) -> DataFrame:
    """Per repository: files found, skipped and kept, lines, folders, top languages.

    One pass over the text counts files and lines per folder and language; that small table is written, and both answers
    come from it.
    """
    seen = with_skip_reason(listing).filter(
        F.col("skip_reason").isNull() | (F.col("skip_reason") != "directory")
    )
    folder = F.regexp_extract("file_path", r"^(.*)/[^/]*$", 1).alias("folder")
    kept = F.col("skip_reason").isNull().alias("kept")
    # A text has one line more than line ends; skipped files are not read.
    lines = F.when(kept, F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit(""))) + 1).alias("lines")
    counted = seen.select("repo", folder, language(F.col("file_path")).alias("language"), kept, lines)
    counted = materialize(
        counted.groupBy("repo", "folder", "language", "kept").agg(F.count("*").alias("n"), F.sum("lines").alias("lines")), "counted"
    )
    totals = counted.groupBy("repo").agg(
        F.sum("n").alias("total_found"),
        F.sum(F.when(~F.col("kept"), F.col("n")).otherwise(0)).alias("total_skipped"),
        F.sum(F.when(F.col("kept"), F.col("n")).otherwise(0)).alias("total_files"),
        F.sum("lines").alias("total_lines"),
        F.countDistinct(F.when(F.col("kept") & (F.col("folder") != ""), F.col("folder"))).alias("directory_count"),
    )
    rank = Window.partitionBy("repo").orderBy(F.desc("n"), "language")
    best = (
        counted.filter("kept").groupBy("repo", "language")
        .agg(F.sum("n").alias("n"))
        .withColumn("rank", F.row_number().over(rank))
        .filter(F.col("rank") <= top)
        .groupBy("repo")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "language", "n"))).alias("best"))
    )
    label = F.array_join(
        F.transform("best", lambda b: F.concat(b["language"], F.lit(":"), b["n"].cast("string"))), ", "
    )
    return totals.join(best, "repo", "left").select(
        *totals.columns, F.coalesce(label, F.lit("")).alias("top_languages")
    )


def normalize_repo_urls(urls: DataFrame) -> DataFrame:
    """Clean repository addresses and say why one is refused."""
    trimmed = F.rtrim(F.trim("url"), F.lit("/"))
    cut = F.regexp_replace(trimmed, r"(?i)(?<=.)/(tree|blob)/.*$", "")
    clean = F.regexp_replace(cut, r"(?i)\.git$", "")
    host = F.lower(F.regexp_extract("clean", r"(?i)^https?://(?:[^/?#]*@)?(\[[^\]]*\]|[^/:?#]*)", 1))
    path = F.regexp_extract("clean", r"(?i)^https?://[^/?#]*([^?#]*)", 1)
    parts = F.filter(F.split("path", "/"), lambda p: p != "")
    private = F.col("host").rlike(
        r"^(0|10|127)\.\d+\.\d+\.\d+$|^169\.254\.\d+\.\d+$|^192\.168\.\d+\.\d+$"
        r"|^172\.(1[6-9]|2\d|3[01])\.\d+\.\d+$|^\[fe[89ab][0-9a-f]:"
    )
    reason = (
        F.when(F.trim("url") == "", "empty")
        .when(~F.col("clean").rlike(r"(?i)^https?://"), "scheme")
        .when(F.col("clean").contains("@"), "credentials")
        .when(F.col("host") == "", "invalid")
        .when(F.col("host").isin("localhost", "[::1]"), "local address")
        .when(private, "private address")
        .when(~F.col("host").isin(vocab.ALLOWED_HOSTS), "host")
        .when(F.size("parts") < 2, "path")
    )
    ok = F.col("reason").isNull()
    return (
        urls.withColumn("cut", cut)
        .withColumn("clean", clean)
        .withColumn("host", host)
        .withColumn("path", path)
        .withColumn("parts", parts)
        .withColumn("reason", reason)
        .select(
            "page_id", "url", "reason",
            F.when(ok, F.col("parts")[0]).alias("owner"),
            F.when(ok, F.col("parts")[1]).alias("name"),
            F.when(ok & F.col("cut").rlike(r"(?i)\.git$"), F.col("cut"))
            .when(ok, F.concat("cut", F.lit(".git"))).alias("clone_url"),
        )
    )
