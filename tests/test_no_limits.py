"""Nothing is left out however many objects, entries, stashes or blocks a repository has."""

from pyspark.sql import functions as F

from sievebase.operators import forensics, history, quality, scoring
from sievebase.sources.corpus import kept_files


def test_all_lost_objects_are_searched(spark):
    n = 700
    objects = spark.range(2 * n).select(
        F.lit("r").alias("repo"), F.format_string("%040d", "id").alias("hash"), F.when(F.col("id") < n, "blob").otherwise("commit").alias("obj_type"),
        F.lit("dangling").alias("reach"), F.lit(11 * 1024 * 1024).cast("long").alias("size_bytes"), F.lit("a/.env").alias("touched_paths"),
        F.lit('password = "abcdefgh1"').alias("content"), F.lit(0).cast("long").alias("commit_time"),
    )
    assert forensics.dangling_blob_secrets(objects).count() == n
    assert forensics.unreachable_sensitive_commits(objects).count() == n
    assert forensics.large_pack_objects(objects).count() == 2 * n
    assert forensics.dangling_blob_secrets(objects, 500).count() == 500


def test_all_log_entries_and_stashes_are_searched(spark):
    reflog = spark.range(900).select(
        F.lit("r").alias("repo"), F.format_string("%040d", "id").alias("hash"), F.format_string("HEAD@{%d}", "id").alias("entry"), F.lit("commit").alias("action"),
        F.timestamp_seconds("id").alias("ts"), F.lit("rotate token").alias("message"),
    )
    assert forensics.reflog_sensitive_messages(reflog).count() == 900
    stashes = spark.range(60).select(
        F.lit("r").alias("repo"), F.format_string("%040d", "id").alias("hash"), F.format_string("stash@{%d}", "id").alias("ref_name"),
        F.lit("a secret").alias("message"), F.lit("nothing").alias("diff"),
    )
    assert forensics.stash_secrets(stashes).count() == 60


def test_all_duplicate_blocks_are_reported(files):
    def body(k):
        return "\n".join(f"statement number {k} line {i};" for i in range(8))

    table = files({f"{name}{k}.cs": body(k) for k in range(40) for name in "abcde"})
    rows = quality.duplicate_blocks(table).collect()
    assert len(rows) == 40 and all(r.file_count == 5 for r in rows)
    assert quality.duplicate_blocks(table, per_repo=15).count() == 15


def test_large_files_and_long_tokens_are_kept(files):
    long = "".join(chr(97 + i * 7 % 26) + str(i * 3 % 10) for i in range(60))
    table = files({"big.cs": "x" * 600_000 + "\n" + long})
    assert kept_files(table).count() == 1 and kept_files(table, 512_000).count() == 0
    assert long in {r.token for r in forensics.high_entropy_tokens(table).collect()}


def test_sign_ins_change_each_user_once(spark):
    users = spark.createDataFrame([(1, "a@x", "PRO"), (2, "b@x", "FREE")], "user_id long, email string, plan_type string").withColumn(
        "last_login", F.lit("2020-01-01 00:00:00").cast("timestamp_ntz")
    )
    logins = spark.createDataFrame([(1, "a@x", 1), (1, "a@x", 2), (9, "n@x", 3), (9, "n@x", 4), (8, "a@x", 5)], "user_id long, email string, login_no long")
    got = {(r.user_id, r.email, r.plan_type, r.action) for r in history.user_upsert(users, logins, "2025-06-01 00:00:00").collect()}
    assert got == {(8, "a@x", "PRO", "updated"), (2, "b@x", "FREE", "kept"), (9, "n@x", "FREE", "inserted")}


def test_chains_rank_endpoints_only(spark):
    rows = [("r", "f", n, s, t, 75, d, None, None) for n, s, t, d in [
        (3, "Warning", "Unprotected API Endpoint", "b"), (3, "Warning", "Unprotected API Endpoint", "a"), (9, "Warning", "Unprotected API Endpoint", "c"),
        (3, "Info", "No Input Validation on Endpoint", "x"), (4, "Warning", None, "y"),
    ]] + [("r", "g", 1, "Warning", "Unprotected API Endpoint", 75, "z", None, None), ("r", "g", 1, "Warning", "Flow", 95, "z", "trace", None)]
    findings = spark.createDataFrame(rows, "repo string, file_path string, line_number int, severity string, title string, confidence_score int, description string, data_flow_trace string, reachability_status string")
    got = {(r.file_path, r.line_number, r.description[0], r.severity, r.confidence_score) for r in scoring.attack_chains(findings).collect()}
    assert got == {
        ("f", 3, "a", "Critical", 90), ("f", 3, "b", "Warning", 75), ("f", 9, "c", "Warning", 75), ("f", 3, "x", "Info", 75), ("f", 4, "y", "Warning", 75),
        ("g", 1, "z", "Warning", 75), ("g", 1, "z", "Critical", 100),
    }
