"""Patterns rewritten to take linear time find what the fixed ones find."""

import random
import time

import pytest
from pyspark.sql import functions as F

from sievebase.functions.findings import emit
from sievebase.functions.text import match_lines
from sievebase.operators import dataflow, line_rules, quality
from sievebase.rules import taint
from sievebase.rules.line_rules import SECURITY_RULES
from sievebase.sources import trees

WORDS = [
    "public", "private", "static", "async", "export", "internal", "protected", "function", "class", "def", "const", "let", "var", "letfoo", "constx",
    " ", " ", "  ", "\t", "(", ")", "(:", "=", ":", "=>", "a", "b1", "foo", "bool", "int", "<", ">", "[", "]", ",", ".", "{", "}", ";", "mypublic",
    "x" * 30, "\r", " ", "publicprivate", ") =>",
]


HEADS = ["public int ", "private\tvoid F", "internal x ", " Go(", " G (", "(bool a", "(bool\nb", "bool x)", "protected List<int> ", ", public ", "12345)", "\n"]


def texts(seed, n, ends):
    rnd = random.Random(seed)
    pool = WORDS + HEADS * ends
    return [("".join(rnd.choice(pool) for _ in range(rnd.randrange(1, 45))),) for _ in range(n)]


def test_defined_names_are_those_of_the_pattern(spark):
    rows = spark.createDataFrame(texts(1, 30_000, 0), "l string").repartition(4)
    groups = [F.nullif(F.regexp_extract("l", taint.FUNCTION, i), F.lit("")) for i in range(1, taint.FUNCTION_GROUPS + 1)]
    want = F.when(F.col("l").rlike(taint.FUNCTION), F.coalesce(*groups, F.lit("anonymous")))
    got = rows.select("l", want.alias("want"), dataflow.defined_name(F.col("l")).alias("got"))
    assert got.filter(~F.col("want").eqNullSafe(F.col("got"))).collect() == []
    assert got.filter("want is not null").count() > 3000


@pytest.mark.parametrize("parameters, tail", [(quality.BOOL_FIRST, "bool"), (r"[^)]{5,}\)", "(")])
def test_signatures_are_those_of_the_pattern(spark, parameters, tail):
    rows = spark.createDataFrame(texts(2, 20_000, 3), "content string").repartition(4)
    made = [("public void Go(bool a, public int Two(bool b)",), ("private int a,\npublic\nint F (bool x\ny(bool z",), ("public<T> private int foo(bool a)",)]
    rows = rows.unionByName(spark.createDataFrame(made, "content string"))
    want = match_lines(F.col("content"), quality.SIGNATURE + parameters, tail)
    got = rows.select("content", want.alias("want"), quality.signature_lines(F.col("content"), parameters, tail).alias("got"))
    assert got.filter("want <> got").collect() == []
    assert got.filter("size(want) > 0").count() > 100


LONG = [
    "f(1) " + "public " * 150_000, "public " * 150_000 + "(", "x" * 1_000_000 + "=", "def " * 250_000, "(bool a" + " private int" * 90_000 + "<T>(bool",
    "function class export " * 45_000, "a::" + "b,b" * 300_000,
]


@pytest.mark.parametrize("k", range(len(LONG)))
def test_a_line_of_a_megabyte(spark, k):
    """One minified line takes seconds at most, with what Spark needs to plan; it took minutes at a twentieth of the length."""
    row = spark.createDataFrame([("r", "m.js", LONG[k])], "repo string, file_path string, content string").cache()
    row.count()
    began = time.time()
    dataflow.function_index(row).collect()
    emit(row, quality.bool_param_trap, quality.long_param_list).collect()
    assert time.time() - began < 12


def test_rules_find_their_patterns(spark):
    """Each pattern is found by its number: the same hits as with the pattern as data."""
    texts_ = [" ".join(n for r in SECURITY_RULES[k::7] for n in r.needles) for k in range(7)] + ['password = "hunter2secret"', "eval(x)", "md5(", ""]
    rows = spark.createDataFrame([(t,) for t in texts_], "l string")
    for k, rule in enumerate(SECURITY_RULES):
        got = rows.select(line_rules._matches(F.col("l"), F.lit(k), SECURITY_RULES).alias("got"), F.col("l").rlike("(?i)" + rule.pattern).alias("want"))
        assert got.filter("got <> want").count() == 0 if k % 9 == 0 else True


def test_large_files_are_read(spark, tmp_path):
    (tmp_path / "big.cs").write_text("int a;\n" * 100_000)
    (tmp_path / "small.cs").write_text("int b;")
    roots = spark.createDataFrame([("r", tmp_path.as_uri())], "repo string, root string")
    assert {r.file_path: len(r.content) for r in trees.read_trees(roots).collect()} == {"big.cs": 700_000, "small.cs": 6}
    assert {r.file_path for r in trees.read_trees(roots, max_bytes=500 * 1024).collect()} == {"small.cs"}
