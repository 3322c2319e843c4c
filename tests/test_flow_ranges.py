"""Flows by segments and ranges against plain Python, also where a file is cut into many ranges."""

import random
import re

import pytest

from sievebase.operators import dataflow
from sievebase.rules import taint

LINES = [
    "const a = req.query.name", "let b = req.body.id", "go(a)", "db.query(name)", "cursor.execute(id)", "x = validate(name)", "", "trim(q)",
    "function go(name) {", "user.name = name", "save.id = id", "document.write(user.name)", "el.innerHTML = save.id", "other(name)", "go(id)",
    "export function send(v) {", "conn.execute(v)", "send(name)", "send(id); go(name)",
]
N_SOURCES = 2


def made(seed, n):
    rnd = random.Random(seed)
    return [rnd.choice(LINES) for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    return {f"f{k}.js": made(k, [0, 5, 12, 30, 90][k % 5]) for k in range(25)}


@pytest.fixture(scope="module")
def table(spark, texts):
    return spark.createDataFrame([("r", p, "\n".join(t)) for p, t in texts.items()], "repo string, file_path string, content string").cache()


def facts_of(lines):
    sources, sinks, names = [], [], []
    checks = [i for i, l in enumerate(lines, 1) if re.search(taint.SANITIZER, l)]
    for i, l in enumerate(lines, 1):
        for rule, (pattern, _) in enumerate(taint.SOURCES):
            if found := re.search(pattern, l):
                var = [p for p in re.split(r"[.\[\] ()]", found[0]) if len(p) > 1 and p not in taint.NOT_A_VARIABLE]
                sources.append((i, rule, found[0], var[-1] if var else ""))
        for rule, (pattern, kind, weakness) in enumerate(taint.SINKS):
            if re.search(pattern, l):
                sinks.append((i, rule, kind, weakness))
        if found := re.search(taint.FUNCTION, l):
            names.append((next((g for g in found.groups() if g), "anonymous"), i))
        if re.search(taint.EXPORT, l) and (found := re.search(taint.EXPORTED_NAME, l)):
            names.append((found[1], 0))
    return sources, sinks, checks, names


def free(checks, start, end):
    return not any(start <= c < end for c in checks)


@pytest.mark.parametrize("width", [1, 4, 4096])
def test_flows_inside_a_file(table, texts, monkeypatch, width):
    monkeypatch.setattr(dataflow, "RANGE", width)
    want = set()
    for path, lines in texts.items():
        sources, sinks, checks, names = facts_of(lines)
        first = lambda hits: {h[0]: h for h in reversed(hits)}.values()
        for s in first(sources):
            called = [i for i in range(s[0] + 1, len(lines) + 1) if lines[i - 1].strip() and s[3] in lines[i - 1] and any(n in lines[i - 1] for n, _ in names)]
            for k in first(sinks):
                if k[0] > s[0] and free(checks, s[0], k[0]):
                    want.add((path, s[0], k[0], bool(called) and called[0] <= k[0]))
    got = dataflow.intra_file_flows(table).select("file_path", "line_number", "sink_line", "via_call").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) and want


@pytest.mark.parametrize("width", [2, 4096])
@pytest.mark.parametrize("calls", ["identifier", "substring"])
def test_flows_between_files(table, texts, monkeypatch, width, calls):
    monkeypatch.setattr(dataflow, "RANGE", width)
    reach = []
    for path, lines in texts.items():
        _, sinks, checks, names = facts_of(lines)
        reach += [(path, n, k[0]) for n, d in names for k in sinks if k[0] > d and free(checks, d, k[0])]
    want = set()
    for path, lines in texts.items():
        for line, _, _, var in facts_of(lines)[0]:
            near = [l for l in lines[line : line + taint.CALL_WINDOW] if l.strip() and var in l]
            words = {w for l in near for w in re.findall(r"\w+", l)}
            want |= {(path, line, p, k) for p, n, k in reach if p != path and (n in words if calls == "identifier" else any(n in w for w in words))}
    got = dataflow.cross_file_flows(table, calls=calls).select("file_path", "line_number", "target_file", "sink_line").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) and want


@pytest.mark.parametrize("width", [3, 4096])
def test_flows_through_properties(table, texts, monkeypatch, width):
    monkeypatch.setattr(dataflow, "RANGE", width)
    want = {}
    for path, lines in texts.items():
        sources, sinks, checks, _ = facts_of(lines)
        for line, _, _, var in sources:
            for at in range(line + 1, min(len(lines), line + taint.PROPERTY_WINDOW) + 1):
                if found := re.search(r"(\w+\.\w+)\s*=\s*" + re.escape(var), lines[at - 1]):
                    for k in sinks:
                        if k[0] >= at and free(checks, at, k[0]) and found[1] in lines[k[0] - 1]:
                            key = (path, found[1], k[0])
                            want[key] = min(want.get(key, line), line)
    got = dataflow.property_taint(table).select("file_path", "property", "sink_line", "line_number").collect()
    assert {tuple(r)[:3]: r[3] for r in got} == want and want


def test_facts_hold_no_text(table):
    """After the first projection there are line numbers, names, matched expressions and identifiers only."""
    kinds = dict(dataflow.flow_facts(table).dtypes)
    assert "ls" not in kinds and "content" not in kinds and not any(v == "string" for k, v in kinds.items() if k not in ("repo", "file_path"))


def test_a_name_that_all_files_share_is_dealt_over_tasks(spark):
    from pyspark.sql import functions as F

    from sievebase.functions.pairs import each_pair
    from sievebase.session import materialize

    hot = F.when(F.col("id") % 50 == 0, F.col("id")).when(F.col("id") % 70 != 0, 7).alias("name")
    left = materialize(spark.range(400).select(hot, F.col("id").alias("a")), "left")
    right = materialize(spark.range(300).select(hot, F.col("id").alias("b")), "right")
    got = each_pair(left, right, ["name"], 16)
    want = left.join(right, "name")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and got.count() > 100_000
    most = got.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most < got.count() / 20


def test_pairs_of_one_name_are_findings_without_a_shuffle(spark):
    """What leaves the join on a name goes to the findings as it is, unless both lines could meet on a second name."""
    rows = [("r", f"{k}.js", "const a = req.params.name\nsend(name)\nexport function send(v) {\nconn.execute(v)\n") for k in range(6)]
    flows = dataflow.cross_file_flows(spark.createDataFrame(rows, "repo string, file_path string, content string"))
    found = {(r.file_path, r.target_file) for r in flows.collect()}
    assert found == {(f"{a}.js", f"{b}.js") for a in range(6) for b in range(6) if a != b}
    plan = flows._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan.split("Aggregate")[0]
