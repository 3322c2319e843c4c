"""Methods, loops and nesting of files that no row should hold: slices of lines, combined by a tree.

Input are slices (``sources/slices.py``): repo, file_path, slice (from 0), first_line (from 1), ls (its lines).
Results equal those of ``quality`` and ``performance`` on whole files, wherever files are cut.

A walk over lines has no block open, or one that opened at some line and has a depth. What a slice does to either is a
small summary: where the walk stands after it if no block was open before; and, as a block open with depth D closes at
the first line whose depth change since the slice's start is -D or less, the new least depth changes with their lines
and where the walk stands after closing there. Summaries of neighbours compose to one of the same kind, so groups of
ARITY slices are combined to one summary, and those again, to one for each file. Then what is open at the start of each
group goes down the tree to the slices, which walk their lines once more from there.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievebase.functions.findings import as_rows
from sievebase.functions.text import brace_delta
from sievebase.operators.performance import LOOP
from sievebase.operators.quality import BRANCH, METHOD, deep_nesting

ARITY = 64
FILE = ["repo", "file_path"]
Store = Callable[[DataFrame, str], DataFrame]


class Open(NamedTuple):
    """An open block: its name, first line, depth and branches so far."""

    name: str
    first: int
    depth: int
    weight: int


class Close(NamedTuple):
    """Where a block closes that was open with depth ``-level`` or less: the line, branches up to it, what is open after."""

    level: int
    line: int
    weight: int
    after: Open | None


class Summary(NamedTuple):
    """What lines do to a walk: what is open after them if nothing was before, changes of depth and branches, and closings."""

    fresh: Open | None
    delta: int
    weight: int
    closes: list[Close]

    def text(self) -> str:
        return json.dumps(self)

    @staticmethod
    def of(text: str) -> Summary:
        fresh, delta, weight, closes = json.loads(text)
        opened = lambda x: None if x is None else Open(*x)
        return Summary(opened(fresh), delta, weight, [Close(a, b, c, opened(d)) for a, b, c, d in closes])


def after(summary: Summary, state: Open | None) -> Open | None:
    """What is open after the lines of a summary."""
    if state is None:
        return summary.fresh
    for close in summary.closes:
        if close.level <= -state.depth:
            return close.after
    return state._replace(depth=state.depth + summary.delta, weight=state.weight + summary.weight)


def composed(one: Summary, two: Summary) -> Summary:
    closes = [c._replace(after=after(two, c.after)) for c in one.closes]
    least = closes[-1].level if closes else None
    for c in two.closes:
        if least is None or c.level + one.delta < least:
            closes.append(Close(c.level + one.delta, c.line, one.weight + c.weight, c.after))
    return Summary(after(two, one.fresh), one.delta + two.delta, one.weight + two.weight, closes)


class Lines(NamedTuple):
    """A slice's lines as the walk sees them; ``heads`` has the names by place."""

    first_line: int
    heads: dict[int, str]
    deltas: list[int]
    weights: list[int]
    braces: list[bool]


def walk(lines: Lines, state: Open | None, start: int, early: bool) -> Iterator[tuple[Open, int] | Open]:
    """Blocks that close from place ``start`` on, with their last lines; then the one that is open at the end, if any."""
    for k in range(start, len(lines.deltas)):
        line = lines.first_line + k
        if state is None:
            if k not in lines.heads:
                continue
            state = Open(lines.heads[k], line, 0, 0)
        state = state._replace(depth=state.depth + lines.deltas[k], weight=state.weight + lines.weights[k])
        if state.depth <= 0 and (line > state.first or (early and lines.braces[k])):
            yield state, line
            state = None
    if state is not None:
        yield state


def summarized(lines: Lines, early: bool) -> Summary:
    def rest(start: int) -> Open | None:
        last = None
        for last in walk(lines, None, start, early):
            pass
        return last if isinstance(last, Open) else None

    closes: list[Close] = []
    depth = weight = 0
    known: dict[int, Open | None] = {}
    heads = sorted(lines.heads)
    for k, (delta, branches) in enumerate(zip(lines.deltas, lines.weights)):
        depth, weight = depth + delta, weight + branches
        if not closes or depth < closes[-1].level:
            # Nothing opens before the next head: starts between two heads are one.
            head = next((h for h in heads if h > k), None)
            if head is not None and head not in known:
                known[head] = rest(head)
            closes.append(Close(depth, lines.first_line + k, weight, known.get(head) if head is not None else None))
    return Summary(rest(0), depth, weight, closes)


class Kind(NamedTuple):
    """Which lines open a block and what is counted in it; ``early``: it may close on its first line."""

    name: Callable[[Column], Column]
    weight: Callable[[Column], Column]
    early: bool


METHODS = Kind(lambda l: F.regexp_extract(l, METHOD, 1), lambda l: F.regexp_count(l, F.lit(BRANCH)), False)
LOOPS = Kind(lambda l: F.when(l.rlike(LOOP), "loop").otherwise(""), lambda l: F.lit(0), True)


def _features(slices: DataFrame, kind: Kind) -> DataFrame:
    """Slices as what the walk needs of their lines, without their text."""
    heads = F.filter(F.transform("ls", lambda l, i: F.struct(i.alias("i"), kind.name(l).alias("name"))), lambda x: x["name"] != "")
    return slices.select(
        *FILE, "slice", "first_line", heads.alias("heads"), F.transform("ls", brace_delta).alias("deltas"),
        F.transform("ls", lambda l: kind.weight(l).cast("int")).alias("weights"), F.transform("ls", lambda l: l.contains("}")).alias("braces"),
    )


def _lines(row) -> Lines:  # noqa: ANN001
    heads = {h["i"]: h["name"] for h in row.heads}
    return Lines(int(row.first_line), heads, [int(d) for d in row.deltas], [int(w) for w in row.weights], list(row.braces))


_LEVEL = "repo string, file_path string, at long, summary string"


def _summaries(features: DataFrame, early: bool) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = [summarized(_lines(row), early).text() for row in part.itertuples(index=False)]
            yield pd.DataFrame({"repo": part["repo"], "file_path": part["file_path"], "at": part["slice"], "summary": texts})

    return features.mapInPandas(run, _LEVEL)


def _grouped(level: DataFrame) -> DataFrame:
    """A row for each ARITY neighbours: ``at`` of the group, and its parts' places and summaries in order."""
    parts = F.array_sort(F.collect_list(F.struct("at", "summary")))
    held = level.groupBy(*FILE, F.floor(F.col("at") / ARITY).alias("group")).agg(parts.alias("parts"))
    return held.select(*FILE, F.col("group").alias("at"), F.col("parts.at").alias("places"), F.col("parts.summary").alias("summaries"))


def _combined(level: DataFrame) -> DataFrame:
    """One summary for each ARITY neighbours."""

    def run(groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in groups:
            texts = [reduce(composed, map(Summary.of, found)).text() if len(found) > 1 else found[0] for found in group["summaries"]]
            yield pd.DataFrame({"repo": group["repo"], "file_path": group["file_path"], "at": group["at"], "summary": texts})

    return _grouped(level).drop("places").mapInPandas(run, _LEVEL)


def _starts(level: DataFrame, above: DataFrame) -> DataFrame:
    """What is open at the start of each part of a level, from what is open at the start of the groups above."""

    def run(groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in groups:
            rows = []
            for row in group.itertuples(index=False):
                state = Open(*json.loads(row.state)) if row.state else None
                last = len(row.places) - 1
                for k, (at, text) in enumerate(zip(row.places, row.summaries)):
                    rows.append((row.repo, row.file_path, at, json.dumps(state) if state else ""))
                    if k < last:
                        state = after(Summary.of(text), state)
            yield pd.DataFrame(rows, columns=["repo", "file_path", "at", "state"]).astype({"at": "int64"})

    return _grouped(level).join(above, [*FILE, "at"]).mapInPandas(run, "repo string, file_path string, at long, state string")


def sliced_blocks(slices: DataFrame, kind: Kind, store: Store) -> DataFrame:
    """(repo, file_path, slice, name, first, last, weight) of the blocks that close in a slice, and with a null last of the
    one that is open at its end."""
    features = store(_features(slices, kind), "features")
    levels = [store(_summaries(features, kind.early), "summaries")]
    while (levels[-1].agg(F.max("at")).first()[0] or 0) > 0:
        levels.append(store(_combined(levels[-1]), "summaries"))
    starts = levels[-1].select(*FILE, "at", F.lit("").alias("state"))
    for level in reversed(levels[:-1]):
        starts = store(_starts(level, starts), "starts")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for row in part.itertuples(index=False):
                state = Open(*json.loads(row.state)) if row.state else None
                for found in walk(_lines(row), state, 0, kind.early):
                    block, last = (found, None) if isinstance(found, Open) else found
                    rows.append((row.repo, row.file_path, row.slice, block.name, block.first, last, block.weight))
            frame = pd.DataFrame(rows, columns=["repo", "file_path", "slice", "name", "first", "last", "weight"])
            yield frame.astype({"last": "Int64", "slice": "int64", "first": "int64", "weight": "int64"})

    held = features.join(starts.withColumnRenamed("at", "slice"), [*FILE, "slice"])
    schema = "repo string, file_path string, slice long, name string, first long, last long, weight long"
    return held.mapInPandas(run, schema)


def method_metrics(slices: DataFrame, store: Store) -> DataFrame:
    """Length and complexity of every method that closes."""
    found = sliced_blocks(slices, METHODS, store).filter("last is not null")
    return found.select(
        *FILE, "name", F.col("first").cast("int").alias("line_number"),
        (F.col("last") - F.col("first")).cast("int").alias("length"), (F.col("weight") + 1).cast("int").alias("complexity"),
    )


def loop_context(slices: DataFrame, store: Store) -> DataFrame:
    """Per line: inside a loop before and after that line's closing test."""
    spans = sliced_blocks(slices, LOOPS, store).groupBy(*FILE, "slice").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    held = slices.join(spans, [*FILE, "slice"], "left")
    lines = held.select(*FILE, "spans", "first_line", F.explode(F.sequence(F.lit(0), F.size("ls") - 1)).alias("_k"))
    n = F.col("first_line") + F.col("_k")
    spans_ = F.coalesce("spans", F.array().cast("array<struct<first: bigint, last: bigint>>"))
    inside = lambda upto: F.exists(spans_, lambda b: (n >= b["first"]) & (b["last"].isNull() | upto(b["last"])))
    return lines.select(
        *FILE, n.cast("int").alias("line_number"), inside(lambda last: n <= last).alias("in_loop"), inside(lambda last: n < last).alias("in_loop_after"),
    )


def nesting(slices: DataFrame) -> DataFrame:
    """(repo, file_path, deepest, at): the deepest brace level of a file and the line where it is first reached.

    A slice gives its change of depth, its greatest depth above its start and the line of it; a running sum does the rest.
    """
    kind = "struct<depth: int, deepest: int, at: int>"

    def on_line(acc: Column, line: Column) -> Column:
        signs = F.regexp_extract_all(line["l"], F.lit("[{}]"), F.lit(0))

        def step(a: Column, sign: Column) -> Column:
            depth = a["depth"] + F.when(sign == "{", 1).otherwise(-1)
            deeper = a["deepest"].isNull() | (depth > a["deepest"])
            return F.struct(depth.alias("depth"), F.when(deeper, depth).otherwise(a["deepest"]).alias("deepest"), F.when(deeper, line["i"]).otherwise(a["at"]).alias("at")).cast(kind)

        return F.aggregate(signs, acc, step)

    start = F.struct(F.lit(0).alias("depth"), F.lit(None).cast("int").alias("deepest"), F.lit(None).cast("int").alias("at")).cast(kind)
    numbered = F.filter(F.transform("ls", lambda l, i: F.struct(l.alias("l"), i.alias("i"))), lambda x: x["l"].contains("{") | x["l"].contains("}"))
    each = slices.select(*FILE, "slice", "first_line", F.aggregate(numbered, start, on_line).alias("s"))
    ahead = Window.partitionBy(*FILE).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    depth = F.coalesce(F.sum("s.depth").over(ahead), F.lit(0)) + F.col("s.deepest")
    reached = each.withColumn("deepest", depth).withColumn("at", F.col("first_line") + F.col("s.at")).filter("deepest is not null")
    first = F.max_by(F.struct("deepest", "at"), F.struct("deepest", -F.col("slice"))).alias("m")
    return reached.groupBy(*FILE).agg(first).select(*FILE, F.col("m.deepest").cast("int").alias("deepest"), F.col("m.at").cast("int").alias("at"))


def nesting_depth(slices: DataFrame) -> DataFrame:
    """Files that nest five levels deep or more."""
    return as_rows(nesting(slices).filter("deepest >= 5"), deep_nesting(F.col("deepest"), F.col("at")))
