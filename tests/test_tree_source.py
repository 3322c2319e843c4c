"""Trees as a data source: batch, and a stream that takes each file once, also over a restart."""

import os
from collections import Counter

import pytest

from sievebase.functions import findings as fi
from sievebase.operators import line_rules
from sievebase.sources import corpus
from sievebase.sources.tree_source import TreeSource

T0 = 1_600_000_000


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    spark.dataSource.register(TreeSource)


def put(root, path, text, second):
    file = root / path
    file.parent.mkdir(parents=True, exist_ok=True)
    file.write_bytes(text if isinstance(text, bytes) else text.encode())
    os.utime(file, (T0 + second, T0 + second))


def test_batch(spark, tmp_path):
    put(tmp_path, "r1/src/a.py", "x = 1", 0)
    put(tmp_path, "r1/.env", "A=b", 0)
    put(tmp_path, "r1/node_modules/b.js", "no", 0)
    put(tmp_path, "r1/logo.png", b"\x00", 0)
    put(tmp_path, "r1/.git/config", "[core]", 0)
    put(tmp_path, "r2/big.cs", "int a;\n" * 100_000, 0)
    put(tmp_path, "r2/odd.txt", b"\xff\xfe", 0)
    put(tmp_path, "loose.txt", "no repository", 0)
    read = spark.read.format("repo_tree").option("chunk_bytes", 4).load(str(tmp_path))
    got = {(r.repo, r.file_path): r for r in read.collect()}
    assert set(got) == {("r1", "src/a.py"), ("r1", ".env"), ("r2", "big.cs"), ("r2", "odd.txt")}
    assert len(got["r2", "big.cs"].content) == 700_000 == got["r2", "big.cs"].size_bytes and got["r2", "odd.txt"].content == "��"
    assert got["r1", "src/a.py"].modified_ms == T0 * 1000 and read.rdd.getNumPartitions() >= 3
    kept = spark.read.format("repo_tree").option("keep_git", True).load(tmp_path.as_uri())
    assert ("r1", ".git/config") in {(r.repo, r.file_path) for r in kept.collect()}


def run(spark, root, out, **options):
    """Scan what has arrived since the last run; the checkpoint is all that stays."""
    files = corpus.kept_files(spark.readStream.format("repo_tree").options(settle_ms=0, **options).load(str(root)))
    query = (
        line_rules.security_rule_scan(files).writeStream.format("parquet").option("path", str(out / "rows"))
        .option("checkpointLocation", str(out / "state")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return Counter((r.repo, r.file_path) for r in spark.read.parquet(str(out / "rows")).collect())


SECRET = 'password = "hunter2secret"\n'


@pytest.mark.parametrize("options", [{}, {"chunk_bytes": 40}])
def test_files_added_in_three_steps_are_scanned_once(spark, tmp_path, options):
    root, out = tmp_path / "repos", tmp_path / "out"
    put(root, "r1/a.py", SECRET, 1)
    put(root, "r1/b.py", SECRET, 1)
    one = run(spark, root, out, **options)
    put(root, "r2/c.py", SECRET, 2)
    put(root, "r1/z.py", SECRET, 1)  # the same time as the last mark, a later path
    two = run(spark, root, out, **options)
    three = run(spark, root, out, **options)  # nothing new
    put(root, "r1/a.py", SECRET * 2, 3)  # a new version
    put(root, "r3/d.py", "clean = 1", 3)
    four = run(spark, root, out, **options)
    n = next(iter(one.values()))
    assert one == {("r1", "a.py"): n, ("r1", "b.py"): n}
    assert two == three == {**one, ("r2", "c.py"): n, ("r1", "z.py"): n}
    assert four == {**two, ("r1", "a.py"): 3 * n}


def test_stream_rows_are_those_of_the_batch(spark, tmp_path):
    root = tmp_path / "repos"
    for k in range(12):
        put(root, f"r{k % 3}/f{k}.py", SECRET + "eval(x)\n" * k, k)
    got = run(spark, root, tmp_path / "out", chunk_bytes=100)
    files = corpus.kept_files(spark.read.format("repo_tree").load(str(root)))
    assert got == Counter((r.repo, r.file_path) for r in line_rules.security_rule_scan(files).select(*fi.CORE).collect())
