"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are lowered and every run of other signs than letters and digits
becomes one space. An item of m characters may occur with up to
``floor(error_rate * m)`` = k edits. Cut into k + 1 pieces, one piece at least
survives any k edits unchanged, so an Aho-Corasick automaton over all pieces finds
every occurrence; around each hit Myers' bit-parallel search computes the least
edit distance of the item to any part of the window, exactly.

The benchmark is the stated query set: it goes to the tasks in blocks of bounded
size, each block against all texts, without a shuffle.

Defined cases: a null or empty text has no findings; an item without letters and
digits is no query; short items have k = 0 and are found as they are, inside longer
words as well (an item of one letter is in almost every text, so leave such items out of
the benchmark before cleaning by it); items of equal text are found each; repeated rows are found each; a null doc_id is kept;
whole texts are searched; an empty table on either side gives no findings; other
columns are ignored, or kept by ``clean_documents``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ERROR_RATE = 0.08
BLOCK_CHARS = 4_000_000
FINDING = "item_id long, distance int, budget int, match_end int"

Item = tuple[int, str]


def normalized(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def budget(item: str, error_rate: float) -> int:
    return int(error_rate * len(item))


def best_match(item: str, window: str, limit: int) -> tuple[int, int]:
    """Least edit distance of the item to a part of the window, and where that part ends; limit + 1 if there is none."""
    m = len(item)
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    ones, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = ones, 0, m
    best, at = limit + 1, -1
    for j, c in enumerate(window):
        eq = masks.get(c, 0)
        diagonal = ((((eq & plus) + plus) ^ plus) | eq | minus) & ones
        up, down = (minus | ~(diagonal | plus)) & ones, plus & diagonal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
            if score < best:
                best, at = score, j + 1
        # A part may begin anywhere, so nothing is carried into the lowest row.
        up, down = (up << 1) & ones, (down << 1) & ones
        plus, minus = (down | ~(diagonal | up)) & ones, up & diagonal
    return best, at


class Matcher:
    """One block of items with the automaton of their pieces."""

    def __init__(self, items: list[Item], error_rate: float):
        import ahocorasick

        self.items = [(i, text, budget(text, error_rate)) for i, text in items]
        places: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text, k) in enumerate(self.items):
            cuts = [len(text) * j // (k + 1) for j in range(k + 2)]
            for a, b in zip(cuts, cuts[1:]):
                places.setdefault(text[a:b], []).append((n, a))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, budget, end) of each item that the text holds, at its best place."""
        if not self.items or not text:
            return []
        begins: dict[int, list[int]] = {}
        for end, (size, where) in self.automaton.iter(text):
            for n, offset in where:
                begins.setdefault(n, []).append(end + 1 - size - offset)
        found = []
        for n, starts in begins.items():
            item, own, k = self.items[n]
            best, at = k + 1, -1
            starts.sort()
            first = 0
            while first < len(starts) and best > 0:
                last = first  # hits whose windows overlap are searched together
                while last + 1 < len(starts) and starts[last + 1] - starts[last] <= len(own) + 2 * k:
                    last += 1
                low, high = max(0, starts[first] - k), starts[last] + len(own) + k
                distance, end = best_match(own, text[low:high], best - 1)
                if distance < best:
                    best, at = distance, low + end
                first = last + 1
            if best <= k:
                found.append((item, best, k, at))
        return found


_matchers: dict[int, tuple[list[Item], float, Matcher]] = {}


def _matcher(items: list[Item], error_rate: float) -> Matcher:
    """The block's matcher, made once per worker and block."""
    key = hash((error_rate, *items))
    held = _matchers.get(key)
    if held is None or held[0] != items or held[1] != error_rate:
        _matchers.clear()
        held = _matchers[key] = (items, error_rate, Matcher(items, error_rate))
    return held[2]


def item_blocks(benchmark: DataFrame) -> Iterator[list[Item]]:
    """Normalised items in blocks of bounded text, in order of id, streamed through the driver."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), normalized(F.col("text")).alias("text"))
    block: list[Item] = []
    size = 0
    for row in rows.filter("text != ''").distinct().orderBy("item_id", "text").toLocalIterator():
        if block and size + len(row["text"]) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((row["item_id"], row["text"]))
        size += len(row["text"])
    if block:
        yield block


def _search(docs: DataFrame, items: list[Item], error_rate: float) -> DataFrame:
    schema = f"doc_id long, {FINDING}"

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(items, error_rate)
        for batch in batches:
            rows = [
                (doc, *hit) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for hit in matcher.find(text)
            ]
            if rows:
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["doc_id", "item_id", "distance", "budget", "match_end"]
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalized(F.col("text")).alias("text")).mapInArrow(search, schema)


def find_leaks(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE) -> DataFrame:
    """One row per document and item that it holds: distance, budget, end of the best place in the normalised text."""
    parts = [_search(docs, items, error_rate) for items in item_blocks(benchmark)]
    if not parts:
        return docs.sparkSession.createDataFrame([], f"doc_id long, {FINDING}")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionAll(part)
    return found


def clean_documents(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE) -> DataFrame:
    """The documents that hold no item, with their own columns."""
    for items in item_blocks(benchmark):
        docs = _without(docs, items, error_rate)
    return docs


def _without(docs: DataFrame, items: list[Item], error_rate: float) -> DataFrame:
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(items, error_rate)
        for batch in batches:
            last = batch.num_columns - 1
            clean = [not matcher.find(text) for text in batch.column(last).to_pylist()]
            yield batch.select(list(range(last))).filter(pa.array(clean, pa.bool_()))

    plain = T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema])
    return docs.select("*", normalized(F.col("text")).alias("_normalized")).mapInArrow(keep, plain)
