"""Stored tables: a change writes touched buckets only, all of them or none, and may be made again."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from sievebase.operators import history
from sievebase.sources.stored_table import Conflict, StoredTable, delete_users, upsert_users


def files(root):
    return {os.path.join(d, n): os.stat(os.path.join(d, n)).st_mtime_ns for d, _, names in os.walk(root) for n in names if n.startswith("part-")}


@pytest.fixture
def rows(spark):
    return spark.range(1000).select(F.col("id").alias("scan_id"), (F.col("id") % 100).alias("user_id"), F.lit("x").alias("name"))


def people(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "user_id long")


def test_delete_leaves_other_buckets_alone(spark, tmp_path, rows):
    table = StoredTable.create(rows, str(tmp_path / "t"), "user_id", 16)
    before = files(tmp_path)
    assert delete_users([table], people(spark, [3, 4])) == [2]
    after = files(tmp_path)
    assert {k: after[k] for k in before} == before  # nothing that was there has changed
    assert sum("/data/" in k for k in after.keys() - before.keys()) == 2
    version, paths = table.manifest()
    assert version == 1 and len(paths) == 16
    assert sorted(table.read().collect()) == sorted(rows.filter("user_id not in (3, 4)").collect())


def test_half_done_and_repeated_runs(spark, tmp_path, rows, monkeypatch):
    """A run that dies before its manifest changes nothing; made again it does its work, and again it is no further change."""
    table = StoredTable.create(rows, str(tmp_path / "t"), "user_id", 8)
    commit = StoredTable._commit

    def dies(self, version, paths):
        raise OSError("lost")

    monkeypatch.setattr(StoredTable, "_commit", dies)
    with pytest.raises(OSError):
        delete_users([table], people(spark, [7]))
    assert table.read().count() == 1000
    monkeypatch.setattr(StoredTable, "_commit", commit)
    for _ in range(2):
        delete_users([table], people(spark, [7]))
        assert table.read().filter("user_id = 7").count() == 0 and table.read().count() == 990


def test_two_changes_at_a_time(spark, tmp_path, rows):
    table = StoredTable.create(rows, str(tmp_path / "t"), "user_id", 8)

    def meanwhile(old):
        StoredTable(spark, table.root, table.schema, "user_id", 8).change(people(spark, [2]), lambda r: r.filter("user_id <> 2"))
        return old.filter("user_id <> 1")

    with pytest.raises(Conflict):
        table.change(people(spark, [1]), meanwhile)
    assert {r.user_id for r in table.read().select("user_id").distinct().collect()} == set(range(100)) - {2}


def test_rows_outside_the_touched_buckets_are_refused(spark, tmp_path, rows):
    table = StoredTable.create(rows, str(tmp_path / "t"), "user_id", 8)
    with pytest.raises(ValueError):
        table.change(people(spark, [1]), lambda r: rows)
    assert table.read().count() == 1000


def test_upsert_equals_the_whole_merge(spark, tmp_path):
    T0 = dt.datetime(2024, 1, 1)
    users = spark.createDataFrame([(i, f"u{i}@x.io", "FREE", T0) for i in range(200)], "user_id long, email string, plan_type string, last_login timestamp_ntz")
    logins = spark.createDataFrame([(3, "new3@x.io", 1), (900, "u5@x.io", 2), (901, "fresh@x.io", 3), (3, "later3@x.io", 4)], "user_id long, email string, login_no long")
    table = StoredTable.create(users, str(tmp_path / "u"), "user_id", 32)
    before = files(tmp_path)
    assert upsert_users(table, logins, "2025-06-01 00:00:00") <= 4
    want = history.user_upsert(users, logins, "2025-06-01 00:00:00").select(*users.columns)
    assert sorted(map(tuple, table.read().collect())) == sorted(map(tuple, want.collect()))
    assert {k: files(tmp_path)[k] for k in before} == before
    upsert_users(table, logins, "2025-06-01 00:00:00")
    assert sorted(map(tuple, table.read().collect())) == sorted(map(tuple, want.collect()))


def test_empty_tables_and_changes(spark, tmp_path, rows):
    table = StoredTable.create(rows.limit(0), str(tmp_path / "t"), "user_id", 4)
    assert table.read().count() == 0 and delete_users([table], people(spark, [])) == [0] and delete_users([table], people(spark, [1])) == [1]
    assert table.read().columns == rows.columns
