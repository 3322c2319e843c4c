"""Performance findings, as file-local analyzers over ``content`` and ``ls``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievebase.functions.findings import each_line, finding, when_all, with_lines
from sievebase.functions.text import first_lines, let
from sievebase.operators.blocks import blocks
from sievebase.operators.quality import BLOCKING, SLEEP

# Patterns of the performance smells.
LOOP = r"\b(for|foreach|while)\b"
DATA_ACCESS = (
    r"(?i)\.(Find|Query|Execute|SaveChanges|Submit|FirstOrDefault|SingleOrDefault)\s*\("
    r"|\bSELECT\b|\bINSERT\b|\bUPDATE\b|\bDELETE\b"
)
TEXT_APPEND = r"""\+\s*=\s*["']|["']\s*\+\s*="""
BIG_ARRAY = r"new\s+byte\[\s*(\d{8,})\s*\]"
BIG_ARRAY_BYTES = 10_000_000
TO_LIST_WHERE = r"\.ToList\(\)\s*\.\s*Where\("
COUNT_ZERO = r"\.Count\(\)\s*>\s*0"
RESOURCE = (
    r"(new\s+(SqlConnection|SqlCommand|FileStream|StreamReader|StreamWriter|HttpClient|TcpClient|WebClient))\s*\("
)
USING = r"\busing\s*\("
BOXING = r"(ArrayList|Hashtable)\s*\(|\.Add\s*\(\s*\d+\s*,"
PLAIN_SPLIT = r"\.Split\s*\(\s*[^,)]*\)(?!,\s*StringSplitOptions)"


def _perf(line, severity, title, why, advice, effort="Easy"):
    return finding(line, severity, "Performance", title, why, advice, effort)


def _each(numbers: Column, severity: str, title: str, why: str, advice: str, effort: str = "Easy") -> Column:
    return each_line(numbers, severity, "Performance", title, why, advice, effort)


def _none() -> Column:
    return F.array().cast("array<int>")


def _lines_with(pattern: str, needle: str) -> Column:
    hits = first_lines(F.transform(F.col("ls"), lambda l: l.rlike(pattern)))
    return F.when(F.col("content").contains(needle), hits).otherwise(_none())


def loops() -> Column:
    """Loops of a file: first and last line, last null if never closed."""
    found = blocks(
        F.col("ls"),
        lambda l: F.when(l.rlike(LOOP), "loop").otherwise(""),
        lambda l: F.lit(0),
        closes_on_first_line=True,
    )
    return F.when(F.col("content").rlike(LOOP), found).otherwise(
        F.array().cast("array<struct<name:string,first:int,last:int,weight:int>>")
    )


def _inside(spans: Column, n: Column, after: bool) -> Column:
    """Is line ``n`` in a loop, before or after the closing test of that line."""
    def holds(b: Column) -> Column:
        upto = n < b["last"] if after else n <= b["last"]
        return (n >= b["first"]) & (b["last"].isNull() | upto)

    return F.exists(spans, holds)


def loop_context(files: DataFrame) -> DataFrame:
    """Per line: inside a loop before and after that line's closing test."""
    spans = with_lines(files).withColumn("spans", loops())
    lines = spans.select("repo", "file_path", "spans", F.posexplode("ls").alias("pos", "line"))
    n = F.col("pos") + 1
    return lines.select(
        "repo", "file_path", n.alias("line_number"),
        _inside(F.col("spans"), n, after=False).alias("in_loop"),
        _inside(F.col("spans"), n, after=True).alias("in_loop_after"),
    )


def _loop_lines(spans: Column, test, after: bool = False) -> Column:
    inside = F.transform(F.col("ls"), lambda l, i: test(l) & _inside(spans, i + 1, after))
    return F.when(F.size(spans) > 0, first_lines(inside)).otherwise(_none())


def _data_access(spans: Column) -> Column:
    return _each(_loop_lines(spans, lambda l: l.rlike(DATA_ACCESS)), "Warning", "Potential N+1 Query",
                 "Data is fetched once per turn of a loop.", "Fetch it in one query before the loop.", "Medium")


def _text_append(spans: Column) -> Column:
    return _each(_loop_lines(spans, lambda l: l.rlike(TEXT_APPEND)), "Warning", "String Concatenation in Loop",
                 "Text grows by copying on every turn.", "Collect the parts in a builder.")


def _collection_search(spans: Column) -> Column:
    def test(l: Column) -> Column:
        return l.contains(".Where(") | l.contains(".Select(") | l.contains(".Any(")

    return _each(_loop_lines(spans, test, after=True), "Warning", "LINQ Operation Inside Loop (O(n²))",
                 "A collection is searched on every turn.", "Search it once before the loop.", "Medium")


def n_plus_one() -> Column:
    return let(loops(), _data_access)


def concat_in_loop() -> Column:
    return let(loops(), _text_append)


def linq_in_loop() -> Column:
    return let(loops(), _collection_search)


def loop_findings() -> Column:
    """The three loop checks with the loops found once."""
    return let(loops(), lambda s: F.concat(_data_access(s), _text_append(s), _collection_search(s)))


def sync_blocking_perf() -> Column:
    return _each(_lines_with(BLOCKING, ";"), "Warning", "Synchronous Task Blocking",
                 "The thread waits for a task.", "Await the task.", "Medium")


def thread_sleep_perf() -> Column:
    return _each(_lines_with(SLEEP, "Thread.Sleep("), "Warning", "Thread.Sleep Usage",
                 "The thread is held while waiting.", "Await a delay.")


def large_allocation() -> Column:
    size = F.transform(
        F.col("ls"),
        lambda l, i: F.struct(
            (i + 1).alias("n"),
            F.regexp_extract(l, BIG_ARRAY, 1).try_cast("bigint").alias("bytes"),
        ),
    )
    big = F.when(F.col("content").contains("byte["), F.filter(size, lambda s: s["bytes"] > BIG_ARRAY_BYTES))

    def report(s: Column) -> Column:
        mb = F.floor(s["bytes"] / 1_000_000).cast("string")
        return _perf(s["n"], "Warning", "Large Memory Allocation", F.concat(F.lit("A byte array of "), mb, F.lit(" MB.")),
                     "Read in chunks.", "Medium")

    return F.transform(F.coalesce(big, F.array().cast("array<struct<n:int,bytes:bigint>>")), report)


def materialize_then_filter() -> Column:
    return _each(_lines_with(TO_LIST_WHERE, ".ToList()"), "Info", "Inefficient LINQ: ToList().Where()",
                 "All rows are built before they are filtered.", "Filter first.")


def count_gt_zero() -> Column:
    return _each(_lines_with(COUNT_ZERO, ".Count()"), "Info", "Use .Any() Instead of .Count() > 0",
                 "Everything is counted to test for one.", "Test for any.")


def undisposed_resource() -> Column:
    """A resource is made with no ``using`` on its line or on the line before."""
    hits = F.transform(
        F.col("ls"),
        lambda l, i: l.rlike(RESOURCE) & ~l.rlike(USING)
        & ~((i > 0) & F.coalesce(F.get(F.col("ls"), i - 1), F.lit("")).contains("using")),
    )
    lines = F.when(F.col("content").rlike(RESOURCE), first_lines(hits)).otherwise(_none())
    return _each(lines, "Warning", "IDisposable Without Using Statement",
                 "The resource may stay open.", "Open it in a using statement.")


def boxing_collections() -> Column:
    return _each(_lines_with(BOXING, "("), "Warning", "Boxing in Hot Path",
                 "Values are boxed in an untyped collection.", "Use a typed collection.")


def split_without_options() -> Column:
    return _each(_lines_with(PLAIN_SPLIT, ".Split"), "Info", "String.Split Without StringSplitOptions",
                 "Empty pieces are kept.", "Ask for empty pieces to be dropped.")


def file_read_in_loop() -> Column:
    """A loop word with a file read anywhere after it.

    The first loop word leaves the longest rest, so one search in that rest
    answers for all of them.
    """
    text = F.col("content")

    def follows(word: str, read: str) -> Column:
        at = F.locate(word, text)
        return text.contains(read) & (at > 0) & F.substring(text, at + len(word), F.length(text)).contains(read)

    return when_all(
        (
            follows("for", "File.Read") | follows("while", "ReadLine"),
            _perf(1, "Critical", "File.ReadAllText Inside Loop", "A file is read on every turn of a loop.",
                  "Read it before the loop.", "Hard"),
        )
    )


LINE_CHECKS = (
    sync_blocking_perf, thread_sleep_perf, large_allocation, materialize_then_filter, count_gt_zero,
    undisposed_resource, boxing_collections, split_without_options, file_read_in_loop,
)
LOOP_CHECKS = (n_plus_one, concat_in_loop, linq_in_loop)
FILE_LOCAL = (loop_findings, *LINE_CHECKS)
