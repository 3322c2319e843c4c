"""Folds and positions against plain Python on random texts."""

import random
import re

from sievebase.functions.findings import emit
from sievebase.operators import performance, quality

PIECES = [
    "public int a(int x) {", "  private void b(", "}", "{", "if (x && y) {", "for (;;) {", "while (q) { }", "foreach x",
    "text", "", "  return c(d);", "} else if (z) {", "catch (E e) {", "class K", "publicstatic void m(", "DateTime.Now",
    "catch { }", "DateTime.Now Utc DateTime.Now", "}}}}", "{{{{{{",
]
BRANCH = re.compile(quality.BRANCH)
# The method head in its plain form, used on these short texts only.
HEAD = re.compile(
    r"^\s*(public|private|protected|internal|static|async|override|virtual|abstract|sealed|\s)+\s+\w[\w<>\[\],\s\?]*\s+(\w+)\s*\("
)


def python_methods(lines):
    out, start, name, depth, cx = [], None, "", 0, 1
    for i, line in enumerate(lines):
        m = HEAD.search(line)
        if m and start is None:
            start, name, depth, cx = i, m.group(2), 0, 1
        if start is not None:
            depth += line.count("{") - line.count("}")
            cx += len(BRANCH.findall(line))
            if depth <= 0 and i > start:
                out.append((name, start + 1, i - start, cx))
                start = None
    return out


def python_loops(lines):
    out, inside, depth, start = [], False, 0, 0
    for i, line in enumerate(lines):
        if re.search(performance.LOOP, line) and not inside:
            inside, depth, start = True, 0, i + 1
        before = inside
        if inside:
            depth += line.count("{") - line.count("}")
            if depth <= 0 and (i >= start or "}" in line):
                inside = False
        out.append((i + 1, before, inside))
    return out


def python_nesting(lines):
    deepest = depth = at = 0
    for i, line in enumerate(lines):
        for c in line:
            if c == "{":
                depth += 1
                if depth > deepest:
                    deepest, at = depth, i + 1
            elif c == "}":
                depth -= 1
    return at if deepest >= 5 else None


def texts(n=60):
    rng = random.Random(7)
    return {f"f{i}.cs": "\n".join(rng.choice(PIECES) for _ in range(rng.randint(0, 40))) for i in range(n)}


def test_folds_equal_python(files):
    docs = texts()
    df = files(docs)
    methods = {(r.file_path, r.name, r.line_number, r.length, r.complexity) for r in quality.method_metrics(df).collect()}
    assert methods == {(p, *m) for p, t in docs.items() for m in python_methods(t.split("\n"))}
    loops = {(r.file_path, r.line_number, r.in_loop, r.in_loop_after) for r in performance.loop_context(df).collect()}
    assert loops == {(p, *x) for p, t in docs.items() for x in python_loops(t.split("\n"))}
    nesting = {(r.file_path, r.line_number) for r in emit(df, quality.nesting_depth).collect()}
    assert nesting == {(p, python_nesting(t.split("\n"))) for p, t in docs.items() if python_nesting(t.split("\n"))}


def test_match_lines_equal_python(files):
    docs = texts()
    for analyzer, pattern in [(quality.empty_catch, quality.EMPTY_CATCH), (quality.local_time_usage, quality.LOCAL_TIME)]:
        want = sorted((p, t[: m.start()].count("\n") + 1) for p, t in docs.items() for m in re.finditer(pattern, t))
        got = sorted((r.file_path, r.line_number) for r in emit(files(docs), analyzer).collect())
        assert got == want


def test_results_do_not_depend_on_partitions_or_neighbours(files):
    docs = texts(20)
    run = lambda df: sorted(map(tuple, emit(df, *quality.FILE_LOCAL, *performance.FILE_LOCAL).collect()), key=str)
    one = run(files(docs))
    assert run(files(docs).repartition(7)) == one
    two = run(files(docs).unionByName(files(docs, "other")))
    assert len(two) == 2 * len(one)
    assert [r for r in two if r[0] == "r"] == one
