"""Session defaults and the shared scratch location."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings a job needs whatever the cluster; everything else is left to the
# cluster's own configuration.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Streams with states of their own (lists, timers) are kept there and not on the heap.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


# This rule filters a generator's input for emptiness, and the filter is then
# moved below the projection that computes the array, so that costly arrays of
# matches would be computed twice.
EXCLUDED_RULE = "org.apache.spark.sql.catalyst.optimizer.InferFiltersFromGenerate"


def configure(spark: SparkSession) -> SparkSession:
    for key, value in REQUIRED_CONF.items():
        spark.conf.set(key, value)
    excluded = [r for r in (spark.conf.get("spark.sql.optimizer.excludedRules", None) or "").split(",") if r]
    if EXCLUDED_RULE not in excluded:
        spark.conf.set("spark.sql.optimizer.excludedRules", ",".join([*excluded, EXCLUDED_RULE]))
    return spark


def local_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the benchmark; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("sievebase")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    spark = configure(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_made: list[str] = []
_local: list[str] = []


def _local_base() -> str:
    """One temporary folder for a process in local mode, removed when the process ends."""
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="sievebase-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return _local[0]


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder.

    The folder named in ``spark.checkpoint.dir`` is used when it is set; a local
    temporary folder is taken only in local mode, as in tests.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder")
        base = _local_base()
    _made.append(f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}")
    return _made[-1]


def release_scratch(spark: SparkSession) -> int:
    """Remove all folders that this process got from ``scratch_dir``; their number. Call it when no result of the session is
    read any more: results may read from them."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    paths, _made[:] = list(_made), []
    removed = 0
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        removed += bool(path.getFileSystem(conf).delete(path, True))
    return removed


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """Write a result that several later steps read, and read it back.

    The folder is on shared storage, so lost executors lose nothing; findings
    are tiny next to the text they come from.
    """
    path = scratch_dir(df.sparkSession, purpose)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
