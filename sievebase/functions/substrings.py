"""Substring joins without testing all pairs.

Short texts (identifiers) meet on a key: the first ``width`` characters of the wanted
text (all of it when shorter), and every piece of the searched text that long; a match
on a full-width key is then checked against the whole text. Paths are searched by
automata over blocks of the wanted texts.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievebase.functions.text import let


def key(text: Column, width: int) -> Column:
    return F.substring(text, 1, width)


def pieces(text: Column, width: int) -> Column:
    """All distinct substrings of one to ``width`` characters."""
    lengths = F.sequence(F.lit(1), F.lit(width))
    return let(
        text,
        lambda t: F.array_distinct(
            F.flatten(
                F.transform(
                    F.sequence(F.lit(1), F.length(t)),
                    lambda p: F.transform(
                        F.filter(lengths, lambda w: w <= F.length(t) - p + 1), lambda w: F.substring(t, p, w)
                    ),
                )
            )
        ),
    )


SHARD_PATHS = 50_000
BLOCK_CHARS = 1 << 22


def _first_holding(key: tuple, targets: pd.DataFrame, paths: pd.DataFrame) -> pd.DataFrame:
    """For each target of a block that a path of a shard holds, the least such path: one automaton, one turn over each path."""
    import ahocorasick

    found: dict[str, str] = {}
    if len(targets) and len(paths):
        index = ahocorasick.Automaton()
        for target in targets["target"]:
            index.add_word(target, target)
        index.make_automaton()
        for path, lower in paths[["file_path", "lower"]].sort_values("file_path").itertuples(index=False):
            for _, target in index.iter(lower):
                found.setdefault(target, path)
    return pd.DataFrame({"repo": [key[0]] * len(found), "target": list(found), "dest": list(found.values())}, dtype="object")


def first_path_holding(wanted: DataFrame, paths: DataFrame) -> DataFrame:
    """For each (repo, target) the least path holding the target, ignoring path case.

    ``wanted`` has repo and a non-empty target; ``paths`` has repo and file_path.
    The targets of a repository are cut into blocks and its paths into shards of
    bounded size; each block's automaton runs over each shard and gives one row
    per target found there. No piece of a path is a row.
    """
    # A null holds nothing and is held by nothing.
    asked = wanted.select("repo", "target").filter("target is not null").distinct()
    listed = paths.select("repo", "file_path").filter("file_path is not null")
    blocks = asked.groupBy("repo").agg(F.ceil(F.sum(F.length("target") + 1) / BLOCK_CHARS).cast("int").alias("blocks"))
    shards = listed.groupBy("repo").agg(F.ceil(F.count("*") / SHARD_PATHS).cast("int").alias("shards"))
    parts = blocks.join(shards, "repo")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    place = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    left = asked.join(parts, "repo").select("repo", "target", place("target", "blocks").alias("block"), numbers("shards").alias("shard"))
    right = listed.join(parts, "repo").select(
        F.col("repo").alias("of"), "file_path", F.lower("file_path").alias("lower"), place("file_path", "shards").alias("at"), numbers("blocks").alias("by")
    )
    found = left.groupBy("repo", "shard", "block").cogroup(right.groupBy("of", "at", "by")).applyInPandas(_first_holding, "repo string, target string, dest string")
    return found.groupBy("repo", "target").agg(F.min("dest").alias("dest"))
