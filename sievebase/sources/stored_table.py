"""Tables that change in place: copy-on-write of the buckets that a change touches.

A table is a folder of versions. Rows lie in buckets by a hash of their key; a version's manifest names the folder of each
bucket. A change reads and writes the touched buckets only, to folders of its own, and then adds the next manifest, one
small file that appears whole or not at all. Readers take the greatest manifest, so they see the table before a change or
after it. What a run that died has written is named by no manifest and does no harm; the run is simply made again. Two
changes at a time cannot both add the same manifest: the later one is refused and may be made again.

Manifests are read and written by Spark, so a table may lie wherever Spark writes.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = "version long, bucket int, path string, n_buckets int, key string"


class Conflict(RuntimeError):
    """Another change has added the manifest that this one was about to add."""


class StoredTable:
    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, key: str, n_buckets: int):
        self.spark, self.root, self.schema, self.key, self.n_buckets = spark, root.rstrip("/"), schema, key, n_buckets

    @classmethod
    def create(cls, rows: DataFrame, root: str, key: str, n_buckets: int = 64) -> StoredTable:
        """Store rows as a new table; ``n_buckets`` stays, so choose it for buckets of some hundred MB."""
        table = cls(rows.sparkSession, root, rows.schema, key, n_buckets)
        table._commit(0, table._write(rows, range(n_buckets)))
        return table

    # --- reading ------------------------------------------------------------------------------

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.n_buckets)).cast("int")

    def manifest(self) -> tuple[int, dict[int, str | None]]:
        """The latest version and the folder of each of its buckets (null: empty)."""
        rows = self.spark.read.schema(MANIFEST).json(f"{self.root}/manifest/*")
        last = rows.filter(F.col("version") == rows.agg(F.max("version")).first()[0]).collect()
        return last[0]["version"], {r["bucket"]: r["path"] for r in last}

    def _read(self, paths: list[str | None]) -> DataFrame:
        held = sorted({p for p in paths if p})
        # The key's bucket is part of the folder's name only.
        return self.spark.read.schema(self.schema).parquet(*held) if held else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._read(list(self.manifest()[1].values()))

    # --- changing -----------------------------------------------------------------------------

    def _write(self, rows: DataFrame, buckets) -> dict[int, str | None]:  # noqa: ANN001
        """Write rows of some buckets to a new folder; the folder of each of these buckets."""
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        placed = rows.select(*[F.col(f.name) for f in self.schema.fields], self.bucket().alias("_bucket"))
        placed.repartition("_bucket").write.partitionBy("_bucket").parquet(folder)
        try:
            found = {r["_bucket"] for r in self.spark.read.parquet(folder).select("_bucket").distinct().collect()}
        except AnalysisException:  # no rows, so no files
            found = set()
        strange = found - set(buckets)
        if strange:
            raise ValueError(f"rows of buckets that were not touched: {sorted(strange)[:5]}")
        return {b: f"{folder}/_bucket={b}" if b in found else None for b in buckets}

    def _commit(self, version: int, paths: dict[int, str | None]) -> None:
        rows = [(version, b, paths[b], self.n_buckets, self.key) for b in sorted(paths)]
        target = f"{self.root}/manifest/{version:012d}"
        try:
            self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("errorifexists").json(target)
        except PySparkException as error:
            if "PATH_ALREADY_EXISTS" in str(error):
                raise Conflict(f"version {version} is there already") from error
            raise

    def change(self, keys: DataFrame, change: Callable[[DataFrame], DataFrame]) -> int:
        """Replace the rows of the buckets of ``keys`` (a column of keys) by ``change`` of them; the number of buckets written."""
        version, paths = self.manifest()
        touched = sorted(r["b"] for r in keys.select(F.col(keys.columns[0]).alias(self.key)).select(self.bucket().alias("b")).distinct().collect())
        if not touched:
            return 0
        written = self._write(change(self._read([paths[b] for b in touched])), touched)
        self._commit(version + 1, paths | written)
        return len(touched)


def delete_users(tables: list[StoredTable], users: DataFrame) -> list[int]:
    """Remove the rows of some users from tables that are stored by user; buckets written of each table."""
    gone = users.select("user_id").distinct()
    return [table.change(gone, lambda rows: rows.join(gone, "user_id", "left_anti")) for table in tables]


def upsert_users(table: StoredTable, logins: DataFrame, as_of: str) -> int:
    """Merge sign-ins into the stored users: only buckets of users who are signed in, by id or e-mail, are written."""
    from sievebase.operators.history import user_upsert

    by_mail = table.read().select("user_id", "email").join(logins.select("email").distinct(), "email").select("user_id")
    keys = logins.select("user_id").unionByName(by_mail).distinct()
    names = table.schema.fieldNames()
    return table.change(keys, lambda rows: user_upsert(rows, logins, as_of).select(*names))
