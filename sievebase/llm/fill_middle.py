"""Fill-in-the-middle transformation of documents with a piece table.

Method: a document starts as one descriptor (buffer, start, end) over its immutable
text. Cutting at two places splits descriptors; an arrangement permutes the three
parts and puts descriptors over a buffer of sentinels between them. Outputs and
hashes are streams over the descriptors, so a text is not copied to be transformed.
For restoring, the sentinels are looked for in the output, which gives descriptors
over it, and the inverse permutation puts them back.

Places, forms and rates come from a hash of the seed and doc_id: reruns and other
partitions give the same rows. Parts end after whole units: words with the white
space before them, and white space at the end of a text.

Defined cases: a null text is empty; an empty text or one that holds a sentinel stays
plain; a null doc_id hashes like an empty one; repeated rows get equal results; parts
may be empty; other columns are ignored by the digests and kept by ``fim_texts``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievebase.llm.common import chunks, word_bounds

TEXT, MARKS = 0, 1
MARK_BUFFER = b"<P><S><M>"
PREFIX, MIDDLE, SUFFIX = range(3)
#: The parts of each form in the order of its output; each follows its own sentinel.
ORDERS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
SEED, PERCENT, SPM_PERCENT = 42, 50, 80


class Piece(NamedTuple):
    buffer: int
    start: int
    end: int


Table = list[Piece]
MARK = {PREFIX: Piece(MARKS, 0, 3), SUFFIX: Piece(MARKS, 3, 6), MIDDLE: Piece(MARKS, 6, 9)}


def cut(table: Table, at: int) -> tuple[Table, Table]:
    """The table in two, after ``at`` bytes: at most one descriptor is split."""
    left: Table = []
    for k, piece in enumerate(table):
        length = piece.end - piece.start
        if at < length:
            middle = piece.start + at
            return [*left, *([piece._replace(end=middle)] if at else [])], [piece._replace(start=middle), *table[k + 1 :]]
        left.append(piece)
        at -= length
    return left, []


def arrange(parts: dict[int, Table], form: str) -> Table:
    """The parts in the order of a form, each after its sentinel."""
    return [piece for part in ORDERS[form] for piece in (MARK[part], *parts[part])]


def stream(table: Table, buffers: tuple[memoryview, ...]) -> Iterator[memoryview]:
    return (buffers[p.buffer][p.start : p.end] for p in table)


def digest(parts: Iterable[memoryview]) -> str:
    found = hashlib.sha256()
    for part in parts:
        found.update(part)
    return found.hexdigest()


def restored(output: bytes, form: str) -> Table:
    """Descriptors over an output that give the text it was made from."""
    if form == "plain":
        return [Piece(TEXT, 0, len(output))]
    table, parts = [Piece(TEXT, 0, len(output))], {}
    places = [output.index(MARK_BUFFER[MARK[part].start : MARK[part].end]) for part in ORDERS[form]]
    for part, begin, end in zip(ORDERS[form], places, [*places[1:], len(output)]):
        _, rest = cut(table, begin + len(MARK_BUFFER) // 3)
        parts[part], _ = cut(rest, end - begin - len(MARK_BUFFER) // 3)
    return [piece for part in (PREFIX, MIDDLE, SUFFIX) for piece in parts[part]]


class Form(NamedTuple):
    """What the hash of a document decides."""

    first: int
    second: int
    form: str


def drawn(doc_id: int | None, units: int, plain: bool, seed: int, percent: int, spm_percent: int) -> Form:
    """Where to cut (after so many units, lesser first) and which form to take."""
    found = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(found[8 * k : 8 * k + 8], 16) for k in range(4))
    first, second = sorted((h1 % (units + 1), h2 % (units + 1)))
    form = "plain" if plain or h3 % 100 >= percent else "spm" if h4 % 100 < spm_percent else "psm"
    return Form(first, second, form)


class Made(NamedTuple):
    """One document: its units, form, lengths of prefix and middle in bytes, and the arranged table over its text."""

    units: int
    form: str
    prefix: int
    middle: int
    table: Table
    text: memoryview


def transformed(ids: list[int | None], data: np.ndarray, offsets: np.ndarray, options: tuple[int, int, int]) -> Iterator[Made]:
    """The documents of a chunk, one by one."""
    _, ends, before = word_bounds(data, offsets)
    whole = memoryview(np.ascontiguousarray(data))
    for k, doc_id in enumerate(ids):
        begin, end = int(offsets[k]), int(offsets[k + 1])
        text, lo, words = whole[begin:end], int(before[k]), int(before[k + 1] - before[k])
        last = int(ends[lo + words - 1]) if words else begin
        units = words + (last < end)
        found = bytes(text)
        plain = begin == end or any(MARK_BUFFER[m.start : m.end] in found for m in MARK.values())
        form = drawn(doc_id, units, plain, *options)
        if form.form == "plain":
            yield Made(units, "plain", 0, 0, [Piece(TEXT, 0, end - begin)], text)
            continue
        place = lambda n: 0 if not n else end - begin if n > words else int(ends[lo + n - 1]) - begin  # noqa: E731, B023
        a, b = place(form.first), place(form.second)
        rest, suffix = cut([Piece(TEXT, 0, end - begin)], b)
        prefix, middle = cut(rest, a)
        yield Made(units, form.form, a, b - a, arrange({PREFIX: prefix, MIDDLE: middle, SUFFIX: suffix}, form.form), text)


DIGESTS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"


def fim_digests(docs: DataFrame, seed: int = SEED, percent: int = PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """Per document: units, form, lengths in code points, hashes of the output and of the text restored from it."""
    marks = memoryview(MARK_BUFFER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in chunks(batches):
            chars = np.zeros(len(data) + 1, np.int64)
            np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
            ids, found = rows.column(0).to_pylist(), []
            for doc_id, begin, made in zip(ids, offsets.tolist(), transformed(ids, data, offsets, (seed, percent, spm_percent))):
                a, b = begin + made.prefix, begin + made.prefix + made.middle
                counts = (None, None) if made.form == "plain" else (int(chars[a] - chars[begin]), int(chars[b] - chars[a]))
                output = b"".join(stream(made.table, (made.text, marks)))
                back = digest(stream(restored(output, made.form), (memoryview(output), marks)))
                found.append((doc_id, made.units, made.form, *counts, digest(stream(made.table, (made.text, marks))), back))
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = [f.split(" ")[0] for f in DIGESTS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, DIGESTS)


def fim_texts(docs: DataFrame, seed: int = SEED, percent: int = PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """The documents with their own columns, ``text`` transformed and ``fim_form`` set."""
    marks = memoryview(MARK_BUFFER)

    @F.pandas_udf("struct<text: string, form: string>")
    def run(ids, texts):  # noqa: ANN001, ANN202
        import pandas as pd

        out = []
        batch = pa.RecordBatch.from_arrays([pa.array(texts.tolist(), pa.string())], names=["text"])
        names = [None if pd.isna(i) else int(i) for i in ids]
        for rows, data, offsets in chunks(iter([batch])):
            for made in transformed(names[len(out) : len(out) + rows.num_rows], data, offsets, (seed, percent, spm_percent)):
                out.append((b"".join(stream(made.table, (made.text, marks))).decode(), made.form))
        return pd.DataFrame(out, columns=["text", "form"])

    ident = F.col("doc_id").cast("long").cast("string")
    found = docs.drop("fim_form", "_fim").withColumn("_fim", run(ident, F.col("text").cast("string")))
    return found.withColumn("text", F.col("_fim.text")).withColumn("fim_form", F.col("_fim.form")).drop("_fim")
