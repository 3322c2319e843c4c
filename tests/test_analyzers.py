"""A failing analyzer takes nothing but its own findings away, and is recorded."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from sievebase.functions.findings import COLUMNS, finding, when_all
from sievebase.operators import hygiene, quality
from sievebase.plans import scan
from sievebase.plans.analyzers import Branch, Inputs, branch_of, run_branches
from sievebase.sources import tables


def explosive():
    """Finds one thing in every file, and fails on files with a certain word."""
    item = finding(1, "Info", "Quality", "Seen", "why", "advice")
    return when_all((F.when(F.col("content").contains("BOOM"), F.raise_error(F.lit("cannot read this"))).otherwise(F.lit(True)), item))


def broken():
    return F.col("no_such_column")


def thrower(inputs):
    raise ValueError("not today")


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(f"r{k % 7}", f"src/f{k}.cs", "try { a(); } catch (Exception e) { }\n<<<<<<< HEAD\n" + ("BOOM" if k in (10, 24) else "")) for k in range(60)]
    return spark.createDataFrame(rows, "repo string, file_path string, content string").repartition(3).cache()


def titles(df):
    return Counter((r.repo, r.title) for r in df.collect())


def test_one_failing_repository_of_one_analyzer(corpus):
    local = (quality.empty_catch, explosive, hygiene.merge_markers, quality.task_blocking)
    branches = [Branch(local=tuple(map(branch_of, local))), Branch(whole=("thrower", thrower)), Branch(whole=("deep_paths", lambda x: hygiene.deep_paths(x.files)))]
    found, status = run_branches(branches, Inputs(corpus))
    assert found.columns == COLUMNS
    got = titles(found)
    per_repo = Counter(r.repo for r in corpus.collect())
    for repo, n in per_repo.items():
        assert got[repo, "Empty Exception Handler"] == n and got[repo, "Merge Conflict Markers Left in Code"] == n
        # Files 10 and 24 are both of r3.
        assert got[repo, "Seen"] == (0 if repo == "r3" else n)
    rows = {(r.analyzer, r.repo): r for r in status.collect()}
    assert rows["explosive", "r3"].status == "failed" and "cannot read this" in rows["explosive", "r3"].error
    assert rows["explosive", None].status == "partly failed" and rows["explosive", None].findings == sum(n for r, n in per_repo.items() if r != "r3")
    assert rows["empty_catch", None].status == "ok" and rows["empty_catch", None].findings == 60
    assert {k[1] for k in rows if k[0] == "thrower"} == {None, *per_repo} and rows["deep_paths", None].findings == 0


def test_an_analyzer_that_cannot_be_planned(corpus):
    local = (quality.empty_catch, broken, hygiene.merge_markers)
    found, status = run_branches([Branch(local=tuple(map(branch_of, local)))], Inputs(corpus.filter("repo in ('r1', 'r2')")))
    assert set(titles(found)) == {(r, t) for r in ("r1", "r2") for t in ("Empty Exception Handler", "Merge Conflict Markers Left in Code")}
    assert {(r.analyzer, r.repo) for r in status.filter("status = 'failed'").collect()} == {("broken", "r1"), ("broken", "r2")}


def test_dividing_ends(corpus, monkeypatch):
    """An analyzer that fails everywhere is not tried for every repository."""
    monkeypatch.setattr("sievebase.plans.analyzers.TRIES", 2)

    def always():
        return when_all((F.when(F.length("content") > 0, F.raise_error(F.lit("never"))).otherwise(F.lit(True)), finding(1, "Info", "Quality", "x", "y", "z")))

    found, status = run_branches([Branch(local=(branch_of(always), branch_of(quality.empty_catch)))], Inputs(corpus))
    failed = status.filter("status = 'failed'").collect()
    assert sorted(r.repo for r in failed) == sorted({r.repo for r in corpus.collect()}) and {r.analyzer for r in failed} == {"always"}
    assert found.count() == 60


def test_shared_tables_that_fail_cost_their_users_only(corpus, monkeypatch):
    def fails(files, mode="compat"):
        raise ValueError("no facts")

    monkeypatch.setattr("sievebase.operators.dataflow.flow_facts", fails)
    few = corpus.filter("repo = 'r1'")
    found, status = scan._analyzed(few, None, "identifier")
    failed = {r.analyzer for r in status.filter("status = 'failed'").collect()}
    assert failed == {"intra_file_flows", "cross_file_flows", "property_taint"}
    assert ("r1", "Empty Exception Handler") in titles(found)


def test_nothing_to_scan(spark):
    empty = spark.createDataFrame([], "repo string, file_path string, content string")
    found, status = run_branches(scan.branches(None), Inputs(empty))
    assert found.count() == 0 and {r.status for r in status.collect()} == {"ok"}


def test_findings_without_those_of_a_failed_analyzer_are_no_result(corpus, monkeypatch):
    """What merges findings raises, and so does all that is built on it; the status still tells."""
    monkeypatch.setattr(scan, "branches", lambda git: [Branch(local=(branch_of(explosive), branch_of(quality.empty_catch))), Branch(whole=("thrower", thrower))])
    for query in (scan.merge_analyzers, scan.run_scan):
        with pytest.raises(scan.IncompleteScan, match="explosive: .*cannot read this.*thrower: not today") as raised:
            query(corpus)
        assert {name for name, _ in raised.value.failed} == {"explosive", "thrower"}
    assert {(r.analyzer, r.repo) for r in scan.scan_status(corpus.filter("repo = 'r3'")).filter("status = 'failed'").collect()} == {("explosive", "r3"), ("thrower", "r3")}
    monkeypatch.setattr(scan, "branches", lambda git: [Branch(local=(branch_of(quality.empty_catch),))])
    assert scan.merge_analyzers(corpus).count() == 60


def test_no_mart_is_made_of_a_scan_that_failed(spark, sf_dir, monkeypatch):
    from sievebase.plans import queries

    monkeypatch.setattr(queries, "_scans", {})
    monkeypatch.setattr(scan, "branches", lambda git: [Branch(whole=("thrower", thrower))])
    marts = queries.scoring_queries()
    for name in ("attack_chains", "analysis_summary", "confidence_score", "distinct_critical_titles", "health_score", "file_risk"):
        with pytest.raises(scan.IncompleteScan):
            marts[name](spark, sf_dir)
    assert not queries._scans


def test_null_paths_hold_nothing(spark):
    from sievebase.functions.substrings import first_path_holding

    wanted = spark.createDataFrame([("r", "lib/a"), ("r", None), ("q", "lib/a")], "repo string, target string")
    paths = spark.createDataFrame([("r", None), ("r", "src/Lib/a.py"), ("q", None)], "repo string, file_path string")
    assert [tuple(r) for r in first_path_holding(wanted, paths).collect()] == [("r", "lib/a", "src/Lib/a.py")]
