"""Edges: empty files, line ends, thresholds, versions, skew and brute force."""

import random

import pytest
from pyspark.sql import functions as F

from sievebase.functions import substrings
from sievebase.functions.findings import COLUMNS, FINDING, emit
from sievebase.functions.labels import age_label, duration_label, size_label
from sievebase.functions.substrings import first_path_holding
from sievebase.functions.text import explode_lines
from sievebase.functions.versions import compare
from sievebase.operators import history, hygiene, quality, scoring
from sievebase.plans import scan
from sievebase.sources import sinks, tables, trees
from sievebase.streaming import scan_events


def finding_rows(spark, rows):
    """Findings from dicts; other fields get plain values."""
    base = dict(repo="r", file_path="a.py", line_number=1, severity="Info", category="Security", title="T", description="",
                suggestion="", effort_level="Easy", confidence_score=0)
    data = [tuple({**base, **r}.get(c) for c in COLUMNS) for r in rows]
    schema = "repo string, file_path string, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in FINDING.fields)
    return spark.createDataFrame(data, schema)


def test_lines_keep_blanks_and_carriage_returns(files):
    rows = explode_lines(files({"a": "x\r\n\ny\n", "e": ""})).collect()
    assert [(r.line_number, r.line) for r in rows if r.file_path == "a"] == [(1, "x\r"), (2, ""), (3, "y"), (4, "")]
    assert [(r.line_number, r.line) for r in rows if r.file_path == "e"] == [(1, "")]


def test_empty_and_odd_files_pass_every_analyzer(files):
    df = files({"empty.py": "", "crlf.cs": "// TODO: x\r\nvar a = 1;\r\n", "one": "x"})
    assert {r.title for r in emit(df, *scan.FILE_LOCAL).collect()} >= {"TODO Comment", "TODO Comment in Source"}


@pytest.mark.parametrize("n,expected", [(500, None), (501, "Large File Detected"), (1000, "Large File Detected"), (1001, "Massive File Detected")])
def test_file_size_tiers(files, n, expected):
    got = [r.title for r in emit(files({"a.cs": "\n" * (n - 1)}), quality.large_file_tiers).collect()]
    assert got == ([expected] if expected else [])


def test_duplicate_windows_need_eight_lines_and_two_files(files):
    block = "\n".join(f"statement number {i};" for i in range(8))
    short = "\n".join(f"statement number {i};" for i in range(7))
    assert quality.duplicate_blocks(files({"a": block, "b": "  " + block.upper()})).count() == 1
    assert quality.duplicate_blocks(files({"a": block, "b": short})).count() == 0
    assert quality.duplicate_blocks(files({"a": block + "\n" + block})).count() == 0


def test_versions(spark):
    cases = [("4.17", "4.17.0", 0), ("1.10.0", "1.9.9", 1), ("2.0.0-rc1", "2.0.0", 0), ("1.x.3", "1.0.2", 1), ("1", "1.0.0.1", -1)]
    df = spark.createDataFrame(cases, "a string, b string, want int").select(compare(F.col("a"), F.col("b")).alias("got"), "want")
    assert all(r.got == r.want for r in df.collect())


def test_confidence_factors(spark, files):
    df = files({"a.py": 'x = 1\n# pw\n/* a\npassword\n*/\nprint(password)\n', "b.md": "x"})
    found = finding_rows(spark, [
        dict(line_number=1, severity="Critical"), dict(line_number=2, severity="Critical"), dict(line_number=4, severity="Critical"),
        dict(line_number=6, severity="Critical"), dict(line_number=99), dict(file_path="gone.md"), dict(confidence_score=75, line_number=2),
    ])
    got = {(r.file_path, r.line_number, r.confidence_score): r.severity for r in scoring.confidence_score(found, df).collect()}
    # two files share the title, so every scored finding has that factor
    assert got == {
        ("a.py", 1, 100): "Critical", ("a.py", 2, 40): "Critical", ("a.py", 4, 80): "Critical", ("a.py", 6, 60): "Critical",
        ("a.py", 99, 100): "Info", ("gone.md", 1, 80): "Info", ("a.py", 2, 75): "Info",
    }


def test_below_forty_becomes_info(spark, files):
    df = files({"a.md": "# note"})
    row = scoring.confidence_score(finding_rows(spark, [dict(file_path="a.md", severity="Critical", title="X")]), df).first()
    assert (row.confidence_score, row.severity) == (0, "Info")


def test_health_score_bounds(spark):
    many = finding_rows(spark, [dict(severity=s, title=f"{s}{i}", repo="low") for s in ("Critical", "Warning", "Info") for i in range(30)]
                        + [dict(repo="high", title="No README Found")])
    got = {r.repo: r.health_score for r in scoring.health_score(many).collect()}
    assert got == {"low": 37, "high": 100}


def test_attack_chain_raises_the_first_endpoint_only(spark):
    rows = [dict(title="Unprotected API Endpoint", severity="Warning", line_number=n, confidence_score=75) for n in (9, 3)]
    rows.append(dict(title="No Input Validation on Endpoint", line_number=3, confidence_score=50))
    rows.append(dict(title="Hardcoded Secret Key", line_number=1))
    got = {(r.title, r.line_number): (r.severity, r.confidence_score, r.reachability_status) for r in scoring.attack_chains(finding_rows(spark, rows)).collect()}
    assert got[("Unprotected API Endpoint", 3)] == ("Critical", 90, None)
    assert got[("Unprotected API Endpoint", 9)] == ("Warning", 75, None)
    assert got[("Hardcoded Secret Key", 1)][2] == "Active"


@pytest.mark.parametrize("shard, block", [(50_000, 1 << 22), (7, 20)])
def test_substring_lookup_equals_brute_force(spark, monkeypatch, shard, block):
    monkeypatch.setattr(substrings, "SHARD_PATHS", shard)
    monkeypatch.setattr(substrings, "BLOCK_CHARS", block)
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abAB./") for _ in range(n))
    paths = [(rng.choice("xy"), word(rng.randint(1, 24))) for _ in range(150)]
    wanted = [(rng.choice("xy"), word(rng.randint(1, 12)).lower()) for _ in range(150)]
    wanted += [(r, p.lower()[2:15]) for r, p in paths if len(p) > 14]
    got = first_path_holding(
        spark.createDataFrame(wanted, "repo string, target string"), spark.createDataFrame(paths, "repo string, file_path string")
    )
    want = {}
    for repo, target in set(wanted):
        hits = [p for r, p in paths if r == repo and target in p.lower()]
        if hits:
            want[(repo, target)] = min(hits)
    assert {(r.repo, r.target): r.dest for r in got.collect()} == want


def test_substring_lookup_in_one_large_repository(spark):
    """200,000 paths of one repository in several shards; only targets that are found are rows."""
    paths = spark.range(200_000).select(F.lit("r").alias("repo"), F.concat(F.lit("Src/Part"), F.col("id") % 1000, F.lit("/File"), "id", F.lit(".cs")).alias("file_path"))
    wanted = [("r", "part77/file1077."), ("r", "file199999.cs"), ("r", ".cs"), ("r", "absent"), ("other", ".cs")]
    got = first_path_holding(spark.createDataFrame(wanted, "repo string, target string"), paths)
    least = min(f"Src/Part{k % 1000}/File{k}.cs" for k in range(200_000))
    assert {r.target: r.dest for r in got.collect()} == {"part77/file1077.": "Src/Part77/File1077.cs", "file199999.cs": "Src/Part999/File199999.cs", ".cs": least}


def test_gitignore_pattern_of_only_slashes_matches_anything(files):
    df = files({".gitignore": "zzz\n/*\n", "a.py": "x"})
    assert [r.title for r in hygiene.ineffective_gitignore(df).collect()] == [".gitignore Pattern Ineffective: /*"]


def test_running_scans_equal_brute_force_with_one_hot_moment(spark):
    rng = random.Random(5)
    rows = [(i, rng.randint(0, 3), s, s + rng.randint(0, 50)) for i in range(300) for s in [0 if i < 100 else rng.randint(0, 1000)]]
    df = spark.createDataFrame(rows, "event_id long, client int, start_us long, end_us long")
    for by in ([], ["client"]):
        got = {r.event_id: r.running for r in scan_events.running_scans(df, by, slices=8).collect()}
        for event, client, start, _ in rows:
            moves = [(s, 1, e) for e, c, s, _ in rows if not by or c == client] + [(t, -1, e) for e, c, _, t in rows if not by or c == client]
            assert got[event] == sum(m[1] for m in moves if m <= (start, 1, event))


def test_skew_one_repository_holds_most_rows(spark, files):
    hot = {f"d{i}/f{i}.py": 'password = "abcdef"\n' + "same line of text here\n" * 9 for i in range(300)}
    df = files(hot).unionByName(files({"a.py": "x"}, "cold"))
    assert quality.duplicate_blocks(df).count() == 3
    assert hygiene.repo_presence_checks(df).count() == 10


def test_csv_fields_are_disarmed(spark):
    df = spark.createDataFrame([('=a"b',), ("plain",), ("-1",)], "t string").select(history.csv_field(F.col("t")).alias("c"))
    assert [r.c for r in df.collect()] == ["'=a\"\"b", "plain", "'-1"]


def test_nested_results_are_parsed(spark):
    doc = '{"score": 7, "issues": [{"severity": "Info", "title": "t", "file_path": "f", "line_number": 3}]}'
    rows = history.parse_results(spark.createDataFrame([(1, doc)], "scan_id long, result string")).collect()
    assert [tuple(r) for r in rows] == [(1, 7, "Info", "t", "f", 3)]


def test_labels(spark):
    row = spark.range(1).select(
        size_label(F.lit(256)).alias("a"), size_label(F.lit(1048576)).alias("b"), duration_label(F.lit(61000)).alias("c"),
        age_label(F.lit("2024-01-01 00:00:00").cast("timestamp"), "2024-01-01 01:30:00").alias("d"),
    ).first()
    assert tuple(row) == ("0.3 MB", "1.00 GB", "1m 1s", "1 hours ago")


def test_delete_scan_checks_the_owner(spark):
    scans = spark.createDataFrame([(1, 5), (2, 6), (3, None)], "scan_id long, user_id long")
    left = lambda scan, user: {r.scan_id for r in history.delete_scan(scans, scan, user).collect()}
    assert left(1, 5) == {2, 3} and left(1, 6) == {1, 2, 3} and left(3, 6) == {1, 2}


def test_tree_reader_skips_before_reading(spark, tmp_path):
    tree = {
        "src/a/b/c/d.py": "x = 1", "node_modules/b.js": "y", "c.PNG": "z", "d.min.js": "w", ".env": "k",
        ".github/workflows/w.yml": "on", ".git/config": "c", ".git/objects/x": "o",
    }
    for name, text in tree.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    (tmp_path / "bad.txt").write_bytes(b"a\xffb")
    (tmp_path / "link.py").symlink_to(tmp_path / ".env")
    roots = spark.createDataFrame([("r", tmp_path.as_uri())], "repo string, root string")
    want = {"src/a/b/c/d.py": "x = 1", ".env": "k", ".github/workflows/w.yml": "on", "bad.txt": "a\ufffdb"}
    assert {r.file_path: r.content for r in trees.read_trees(roots).collect()} == want
    want[".git/config"] = "c"
    assert {r.file_path: r.content for r in trees.read_trees(roots, keep_git=True).collect()} == want


def test_whole_scan_runs(spark, files):
    df = files({"a.py": 'password = "abcdef"\n', "b.js": 'app.post("/x", h)\n'})
    blame = spark.createDataFrame(
        [("r", "a.py", 1, "c" * 40, "ann", "a@x", 0, "s")],
        "repo string, file_path string, line_number int, hash string, author string, author_email string, author_time long, summary string",
    )
    rows = scan.run_scan(df, blame=blame).collect()
    one = [r for r in rows if r.title == "Hardcoded Password"][0]
    assert one.introduced_by == "ann in ccccccc (1970-01-01 00:00 UTC)" and one.confidence_score == 80
    assert [r.severity for r in rows if r.title == "Unprotected API Endpoint"] == ["Critical"]


def test_sinks_write_what_was_given(spark, sf_dir, tmp_path):
    issues, scans_ = tables.issues(spark, sf_dir), tables.scans(spark, sf_dir)
    sinks.write_csv_reports(issues, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert back.columns == history.CSV_HEADER.split(",") and back.count() == issues.count()
    assert back.filter(F.col("Suggestion").startswith("'=Fix rule")).count() == issues.count()
    sinks.write_user_exports(scans_, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == scans_.count()


def test_findings_that_have_a_score_are_not_joined(spark, files):
    """They pass beside the join with the lines' facts; a finding without any score (null) passes as well."""
    df = files({"a.py": "x = 1"})
    found = finding_rows(spark, [dict(confidence_score=75), dict(confidence_score=None, severity="Critical"), dict(title="U"), dict(file_path=None, confidence_score=3)])
    scored = scoring.confidence_score(found, df)
    got = sorted((r.title, r.confidence_score if r.confidence_score is not None else -1, r.severity) for r in scored.collect())
    assert got == [("T", -1, "Critical"), ("T", 3, "Info"), ("T", 75, "Info"), ("U", 80, "Info")]
    assert scored._jdf.queryExecution().optimizedPlan().toString().startswith("Union")
