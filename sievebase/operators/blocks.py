"""Brace blocks of a file, found by one fold over its lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievebase.functions.text import brace_delta

_BLOCK = "struct<name:string,first:int,last:int,weight:int>"
_STATE = f"struct<name:string,first:int,depth:int,weight:int,done:array<{_BLOCK}>>"


def _struct(kind: str, **fields: Column) -> Column:
    return F.struct(*[v.alias(k) for k, v in fields.items()]).cast(kind)


def blocks(lines: Column, name_of, weight_of, closes_on_first_line: bool) -> Column:
    """Blocks as ``array<struct<name, first, last, weight>>`` with 1-based lines.

    A block opens on a line for which ``name_of`` is not empty while none is
    open; braces are counted from that line, and it closes on the first line
    where the depth is back at zero or below: a later line, or the first line
    too if ``closes_on_first_line`` and it holds a closing brace. A block still
    open at the end has a null ``last``. One state is kept per file, so the cost
    is linear in the lines and nothing is shuffled.
    """
    features = F.transform(
        lines,
        lambda l, i: F.struct(
            (i + 1).alias("n"), name_of(l).alias("name"), brace_delta(l).alias("delta"),
            weight_of(l).cast("int").alias("weight"), l.contains("}").alias("brace"),
        ),
    )

    def step(acc: Column, x: Column) -> Column:
        opening = (acc["first"] == 0) & (x["name"] != "")
        active = (acc["first"] > 0) | (x["name"] != "")
        first = F.when(opening, x["n"]).otherwise(acc["first"])
        name = F.when(opening, x["name"]).otherwise(acc["name"])
        depth = F.when(opening, 0).otherwise(acc["depth"]) + x["delta"]
        weight = F.when(opening, 0).otherwise(acc["weight"]) + x["weight"]
        late = x["n"] > first
        if closes_on_first_line:
            late = late | x["brace"]
        closing = (depth <= 0) & late
        block = _struct(_BLOCK, name=name, first=first, last=x["n"], weight=weight)
        closed = _struct(
            _STATE, name=F.lit(""), first=F.lit(0), depth=F.lit(0), weight=F.lit(0),
            done=F.concat(acc["done"], F.array(block)),
        )
        still = _struct(_STATE, name=name, first=first, depth=depth, weight=weight, done=acc["done"])
        return F.when(~active, acc).when(closing, closed).otherwise(still)

    def finish(acc: Column) -> Column:
        open_block = _struct(
            _BLOCK, name=acc["name"], first=acc["first"], last=F.lit(None).cast("int"), weight=acc["weight"]
        )
        return F.when(acc["first"] > 0, F.concat(acc["done"], F.array(open_block))).otherwise(acc["done"])

    start = _struct(
        _STATE, name=F.lit(""), first=F.lit(0), depth=F.lit(0), weight=F.lit(0),
        done=F.array().cast(f"array<{_BLOCK}>"),
    )
    return F.aggregate(features, start, step, finish)
