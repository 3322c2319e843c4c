"""Rule fixtures: what must and must not be reported."""

import re

from pyspark.sql import functions as F

from sievebase.functions.findings import emit
from sievebase.operators import dataflow, dependencies, forensics, hygiene, line_rules, quality
from sievebase.plans import scan
from sievebase.rules.line_rules import SECURITY_RULES
from sievebase.sources import tables

SAMPLES = {
    "Hardcoded Password": ['pwd: "abc"', "PASSWORD = 'x y'"],
    "Hardcoded Bearer Token": ["Authorization: Bearer abc", "Authorization: Basic abc"],
    "AWS Access Key Exposed": ["akia" + "0" * 16, "AKIA" + "0" * 15],
    "Hardcoded IP Address in Config": ["at 10.255.0.1 now", "at 11.255.0.1 now"],
    "Unsafe YAML Loading": ["yaml.load(f)", "yaml.load(f, Loader=L)"],
    "JWT None Algorithm Allowed": ["jwt with none algorithm", "jwt algorithm none"],
    "TODO Comment": ["// todo: x", "// todox"],
    "Debug Flag in Config": ['"debug" : true', "'debug': true"],
    "Insecure Random for Auth": ["new Random().Next() token", "new Random().Next()"],
    "Weak Hash: MD5": ["md5.create()", "sha256.create()"],
}


def titles(df, col="title"):
    return {r[col] for r in df.select(col).collect()}


def test_positive_and_negative_lines(files):
    for title, (yes, no) in SAMPLES.items():
        hits = line_rules.security_rule_scan(files({"a.py": yes, "b.py": no})).filter(F.col("title") == title)
        assert [r.file_path for r in hits.collect()] == ["a.py"], title


def test_literals_never_hide_a_match(spark, sf_dir):
    """The scan with its literal tests equals plain patterns over all lines."""
    from sievebase.functions.text import explode_lines
    from sievebase.plans.queries import kept

    files = kept(spark, sf_dir)
    lines = [(r.repo, r.file_path, r.line_number, r.line) for r in explode_lines(files).collect()]
    want = sorted(
        (repo, path, n, rule.title)
        for rule in SECURITY_RULES
        for rx in [re.compile(rule.pattern, re.I)]
        for repo, path, n, line in lines
        if rx.search(line)
    )
    got = line_rules.security_rule_scan(files).select("repo", "file_path", "line_number", "title").collect()
    assert sorted(map(tuple, got)) == want


def snippet(files, *numbers):
    by_number = {i: (ext, body) for i, ext, body in tables.SNIPPETS}
    out = {}
    for n in numbers:
        ext, body = by_number[n]
        path = tables.SNIPPET_PATHS.get(n, "^/f#" + ext).replace("#", str(n)).replace("^", "en")
        out[path] = body.replace("~", "\n")
    return files(out)


def test_fixture_snippets(files):
    local = lambda n: titles(emit(snippet(files, n), *scan.FILE_LOCAL))
    assert {"Hardcoded Password", "Hardcoded API Key"} <= local(0)
    assert {"OS Command Injection", "Insecure Pickle Deserialization"} <= local(1)
    assert {"Potential N+1 Query", "String Concatenation in Loop", "Empty Exception Handler", "Boolean Parameter Trap"} <= local(4)
    assert "Deep Nesting Detected" in local(6)
    assert "Unprotected API Endpoint" in local(2) and "Unprotected API Endpoint" not in local(3)
    assert "Console.WriteLine in Production" in local(17) and "Console.WriteLine in Production" not in local(39)
    five = emit(snippet(files, 5), quality.local_time_usage).collect()
    assert [r.line_number for r in five] == [1]
    assert emit(snippet(files, 17), quality.commented_code_blocks).count() == 1
    assert titles(dependencies.vulnerable_npm(snippet(files, 9))) == {"Vulnerable: lodash 4.17.15"}
    assert titles(dependencies.vulnerable_python(snippet(files, 10))) == {"Vulnerable: Django 3.1.0", "Vulnerable: requests 2.20.0"}
    assert titles(dependencies.vulnerable_dotnet(snippet(files, 11))) == {"Vulnerable: Newtonsoft.Json 12.0.3"}
    assert emit(snippet(files, 13), hygiene.merge_markers).count() == 1
    assert titles(forensics.submodule_risks(snippet(files, 21))) == {"Submodule Path Traversal", "Submodule Using Insecure HTTP"}


def test_flows(files):
    cross = dataflow.cross_file_flows(snippet(files, 15, 16)).collect()
    assert [(r.file_path, r.target_file, r.function_name) for r in cross] == [("en/f16.js", "en/f15.js", "runq")]
    assert dataflow.intra_file_flows(snippet(files, 3)).count() == 0
    assert titles(dataflow.property_taint(snippet(files, 14)), "property") == {"user.name"}


def test_long_function_names_are_checked_on_the_line(files):
    name = "handle_everything_that_comes_in"
    found = dataflow.cross_file_flows(
        files({
            "a.js": "const a = req.query.id\n" + f"{name}(query)",
            "b.js": "const a = req.query.id\n" + name[:-2] + "(query)",
            "t.js": f"function {name}(x) {{\n  db.execute(x)\n}}",
        }),
        calls="substring",
    )
    assert {r.file_path for r in found.collect()} == {"a.js"}


def test_calls_by_whole_identifier(files):
    table = files({
        "a.js": "const a = req.query.id\nrunq(query)", "b.js": "const a = req.query.id\nprerunq(query)",
        "t.js": "function runq(x) {\n  db.execute(x)\n}",
    })
    assert {r.file_path for r in dataflow.cross_file_flows(table).collect()} == {"a.js"}
    assert {r.file_path for r in dataflow.cross_file_flows(table, calls="substring").collect()} == {"a.js", "b.js"}


def test_assigned_mode_follows_the_variable(files):
    f = files({"a.js": "const user = req.body\nother(1)\ndb.query(user)"})
    assert titles(dataflow.taint_sources(f, "compat"), "var") == {""}
    assert titles(dataflow.taint_sources(f, "assigned"), "var") == {"user"}


def test_masked_url(spark):
    one = spark.range(1).select(
        forensics.mask_url(F.lit("https://u:p@Host.com:8443/a/b?x=1#f")).alias("m"), forensics.mask_url(F.lit("git@h:o/r")).alias("n")
    ).first()
    assert tuple(one) == ("https://***:***@host.com/a/b?x=1", "git@h:o/r")
