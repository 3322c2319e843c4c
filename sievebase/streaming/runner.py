"""Running a streaming query to the end of its input and reading its output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievebase.session import scratch_dir


def read_table(spark: SparkSession, sf_dir: str, table: str, max_bytes: int | None = None) -> DataFrame:
    """A table's folder as a file stream with the table's own schema.

    ``max_bytes`` bounds the input of a micro-batch, and with it what a task that
    keeps the rows of one key can hold.
    """
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{table}*.parquet")
    if max_bytes:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    return reader.parquet(sf_dir)


def drain_append(stream: DataFrame, purpose: str) -> DataFrame:
    """Append rows to a shared folder until the input is used up."""
    spark = stream.sparkSession
    root = scratch_dir(spark, purpose)
    query = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", f"{root}/rows").option("checkpointLocation", f"{root}/state")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/rows")


def drain_closed(events: DataFrame, build: Callable[[DataFrame], DataFrame], time: str, purpose: str) -> DataFrame:
    """Append rows until the input is used up, then let the watermark pass everything that is still held.

    ``build`` makes the stream from the events. A closing row, far in the future and
    null but for its time, comes in a micro-batch of its own after all events.
    """
    spark = events.sparkSession
    root = scratch_dir(spark, purpose)
    closing = f"{root}/closing"
    none = spark.createDataFrame([], events.schema)
    none.write.parquet(closing)
    stream = build(events.unionByName(spark.readStream.schema(events.schema).parquet(closing)))

    def run() -> None:
        query = (
            stream.writeStream.format("parquet").outputMode("append")
            .option("path", f"{root}/rows").option("checkpointLocation", f"{root}/state")
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()

    run()
    end = F.lit("2250-01-01 00:00:00")
    spark.range(1).select(*[(end if f.name == time else F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema]).write.mode("append").parquet(closing)
    run()
    return spark.read.schema(stream.schema).parquet(f"{root}/rows")


def drain_update(stream: DataFrame, purpose: str) -> DataFrame:
    """Changed rows of each micro-batch with their ``batch_id``.

    A batch writes a folder of its own, so running it again after a failure
    replaces its rows instead of doubling them.
    """
    spark = stream.sparkSession
    root = scratch_dir(spark, purpose)

    def save(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{root}/rows/batch_id={batch_id}")

    query = (
        stream.writeStream.outputMode("update").foreachBatch(save)
        .option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch_id", T.LongType())])
    return spark.read.schema(schema).parquet(f"{root}/rows")


def latest_rows(changes: DataFrame, *keys: str) -> DataFrame:
    """The row of the last batch per key."""
    rest = [c for c in changes.columns if c not in (*keys, "batch_id")]
    newest = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("r"))
    return newest.select(*keys, "r.*")
