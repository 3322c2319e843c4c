"""Files as slices of lines: repo, file_path, slice (from 0), first_line (from 1), ls (the lines)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievebase.functions.text import split_lines

SLICE_LINES = 2000


def slices_of(files: DataFrame, lines: int = SLICE_LINES) -> DataFrame:
    """Cut files that are rows with ``content``."""
    size = F.size("_ls")
    last = F.floor((size - 1) / lines).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda k: F.struct(
        k.cast("long").alias("slice"), (k.cast("long") * lines + 1).alias("first_line"), F.slice("_ls", k * lines + 1, lines).alias("ls"),
    ))
    return files.withColumn("_ls", split_lines(F.col("content"))).select("repo", "file_path", F.inline(cut))


def read_slices(spark: SparkSession, root: str, repo: str, lines: int = SLICE_LINES) -> DataFrame:
    """Read text files of any size below a folder: Spark splits large ones, and no row holds more than ``lines`` lines.

    A line end at the end of a file gives no empty line; a file without lines has no row.
    """
    rows = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n").text(root)
    rows = rows.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), F.col("value"),
    )
    # Lines of a block are read in order by one task, so their numbers follow each other.
    blocks = rows.groupBy("file", "block").agg(F.min("at").alias("from"), F.count("*").alias("n"))
    ahead = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("file", "block", (F.coalesce(ahead, F.lit(0)) - F.col("from")).alias("shift"))
    placed = rows.join(blocks, ["file", "block"]).select("file", (F.col("at") + F.col("shift")).alias("n"), "value")
    cut = placed.groupBy("file", F.floor(F.col("n") / lines).alias("slice")).agg(F.array_sort(F.collect_list(F.struct("n", "value"))).alias("rows"))
    folder = root.split(":", 1)[-1].strip("/") + "/"
    path = F.url_decode(F.replace(F.substring_index("file", folder, -1), F.lit("+"), F.lit("%2B")))
    return cut.select(F.lit(repo).alias("repo"), path.alias("file_path"), "slice", (F.col("slice") * lines + 1).alias("first_line"), F.transform("rows", lambda x: x["value"]).alias("ls"))
