"""Walks over slices give the rows of whole files, wherever these are cut."""

import random

import pytest

from sievebase.functions import findings as fi
from sievebase.operators import performance, quality, sliced
from sievebase.plans.scan import materialize
from sievebase.sources.slices import read_slices, slices_of

PARTS = [
    "{", "}", "}", "{ {", "} }", "x();", "", "if (a && b) {", "for (;;) {", "while (x) y();", "foreach (a in b)", "for (;;) { }", "} else {",
    "  public void Go(int a) {", "  private int One() { return 1; }", "  public void Late(", ")", "}}}", "{{{",
]


def code(rnd, n):
    return "\n".join(rnd.choice(PARTS) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(6)
    rows = [("r", f"f{k}.cs", code(rnd, rnd.choice([0, 1, 3, 20, 60, 150]))) for k in range(40)]
    rows += [("s", "f0.cs", "  public void Open() {\n" + "  a();\n" * 300 + "}"), ("s", "deep.cs", "{\n" * 9 + "}" * 9), ("s", "empty.cs", ""), ("s", "never.cs", "for (;;) {\n" * 100)]
    return spark.createDataFrame(rows, "repo string, file_path string, content string").cache()


def rows_of(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("lines, arity", [(1000, 64), (150, 2), (7, 3), (3, 2), (1, 8)])
def test_slices_change_nothing(corpus, monkeypatch, lines, arity):
    monkeypatch.setattr(sliced, "ARITY", arity)
    cut = slices_of(corpus, lines).repartition(3).cache()
    assert rows_of(sliced.method_metrics(cut, materialize)) == rows_of(quality.method_metrics(corpus))
    assert rows_of(sliced.loop_context(cut, materialize)) == rows_of(performance.loop_context(corpus))
    assert rows_of(sliced.nesting_depth(cut)) == rows_of(fi.emit(corpus, quality.nesting_depth))


def test_no_group_of_slices_is_a_frame_of_its_own(corpus, monkeypatch):
    """A pandas call for each file takes milliseconds, whatever the file's size; groups go to Python as rows of batches."""
    monkeypatch.setattr(sliced, "ARITY", 2)
    plans = []

    def store(df, purpose):
        plans.append(df._jdf.queryExecution().toString())
        return materialize(df, purpose)

    sliced.loop_context(slices_of(corpus, 7), store)
    assert len(plans) > 4 and not [p for p in plans if "FlatMapGroupsInPandas" in p]


def test_composition_is_the_summary_of_the_whole():
    rnd = random.Random(2)
    for early in (False, True):
        for _ in range(1000):
            n = rnd.randrange(1, 12)
            heads = {k: f"h{k}" for k in range(n) if rnd.random() < 0.3}
            whole = sliced.Lines(1, heads, [rnd.randrange(-2, 3) for _ in range(n)], [rnd.randrange(3) for _ in range(n)], [rnd.random() < 0.5 for _ in range(n)])
            at = rnd.randrange(n)
            left = sliced.Lines(1, {k: v for k, v in heads.items() if k < at}, whole.deltas[:at], whole.weights[:at], whole.braces[:at])
            right = sliced.Lines(1 + at, {k - at: v for k, v in heads.items() if k >= at}, whole.deltas[at:], whole.weights[at:], whole.braces[at:])
            one = sliced.summarized(whole, early)
            assert sliced.composed(sliced.summarized(left, early), sliced.summarized(right, early)) == one
            assert sliced.Summary.of(one.text()) == one


def test_files_are_read_in_slices(spark, tmp_path):
    """Spark cuts a file into several blocks; the lines keep their numbers and order."""
    rnd = random.Random(1)
    texts = {"a/long name+1.cs": code(rnd, 5000), "b.cs": "one", "c.cs": "tail\n"}
    for name, text in texts.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        cut = read_slices(spark, str(tmp_path), "r", 300)
        assert cut.rdd.getNumPartitions() >= 1 and spark.read.text(str(tmp_path / "a")).rdd.getNumPartitions() > 3
        got = {}
        for r in sorted(cut.collect(), key=lambda r: r.slice):
            assert r.first_line == len(got.setdefault(r.file_path, [])) + 1 and len(r.ls) <= 300
            got[r.file_path] += r.ls
        assert got == {n: t.removesuffix("\n").split("\n") for n, t in texts.items()}
        whole = spark.createDataFrame([("r", n, t) for n, t in texts.items()], "repo string, file_path string, content string")
        assert rows_of(sliced.method_metrics(cut, materialize)) == rows_of(quality.method_metrics(whole))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_no_slices(spark):
    none = slices_of(spark.createDataFrame([], "repo string, file_path string, content string"))
    assert not rows_of(sliced.method_metrics(none, materialize)) and not rows_of(sliced.loop_context(none, materialize)) and not rows_of(sliced.nesting_depth(none))
