"""What several operators share: words, shared intermediate tables, word and shingle hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievebase.session import scratch_dir

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\f\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def vocabulary_file(name: str = "byte_bpe_50k.json") -> str:
    """The place of a public tokenizer's vocabulary, the same on the driver and all executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table that later steps read more than once to the shared folder, and read it back."""
    path = scratch_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words_of(text: Column) -> Column:
    """The words of a text as an array; a null or blank text has none."""
    trimmed = F.trim(text, F.lit(SPACE_CHARS))
    return F.when(F.coalesce(F.length(trimmed), F.lit(0)) > 0, F.split(trimmed, SPACE)).otherwise(F.array().cast("array<string>"))


def word_count(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def least_hashes(rows: DataFrame, key: Column, n: int) -> DataFrame:
    """At most ``n`` rows, those of the least hashes. A bound from their number goes ahead, so that tasks give few more than
    ``n`` rows together, however many tasks there are."""
    keyed = rows.withColumn("_hash", key)
    share = 1.2 * n / max(rows.count(), 1)
    bound = -(1 << 63) + int(share * (1 << 64)) + 1
    few = keyed if share >= 1 else keyed.filter(F.col("_hash") <= bound)
    return few.orderBy("_hash").limit(n).drop("_hash")


# --- texts as byte arrays -------------------------------------------------------------------

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
CHUNK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer (two multiply and shift rounds)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BASE = 0xD6E8FEB86659FD93
BASE_INVERSE = pow(BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for k, base in enumerate((BASE, BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Pieces of batches of about CHUNK_BYTES text (one text at least): rows, their bytes, offsets of each row."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        n = len(texts)
        if not n:
            continue
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
        data = texts.buffers()[2]
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        first = 0
        while first < n:
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, "right")) - 1)
            last = min(last, n)
            yield batch.slice(first, last - first), data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
            first = last


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each row the number of words before it (one entry more than rows)."""
    solid = np.zeros(len(data) + 1, bool)
    solid[:-1] = ~IS_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    after_gap = np.ones(len(data) + 1, bool)
    after_gap[1:] = ~solid[:-1]
    starts = np.flatnonzero(solid & (after_gap | edge))
    before_gap = np.ones(len(data) + 1, bool)
    before_gap[:-1] = ~solid[1:] | edge[1:]
    ends = np.flatnonzero(solid & before_gap) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each span: a polynomial over random byte codes, then mixed with the length."""
    power, inverse = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODES[data] * power[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words with A-Z lowered, and for each row the number of words before it."""
    lowered = LOWER[data]
    starts, ends, before = word_bounds(lowered, offsets)
    return span_hashes(lowered, starts, ends), before


def arrow_config(spark: SparkSession) -> None:
    """Bound the batches that Python workers get by bytes as well as by rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


# --- sums of arrays ---------------------------------------------------------------------------

BLOCK_CELLS = 1 << 12


def array_rows(key: str, values: np.ndarray) -> Iterator[tuple[str, int, bytes]]:
    """A one-dimensional array as rows (key, block, bytes), without blocks of zeros."""
    for block in range(0, len(values), BLOCK_CELLS):
        part = values[block : block + BLOCK_CELLS]
        if part.any():
            yield key, block // BLOCK_CELLS, part.tobytes()


ARRAY_SCHEMA = "key string, block int, cells binary"


def sum_arrays(rows: DataFrame, dtype: str, combine: np.ufunc = np.add, short: bool = False) -> dict[str, np.ndarray]:
    """Sums (or what else ``combine`` does) of the arrays of each key. Tasks work by blocks; the driver gets one row per key and block.
    ``short``: the rows hold the upper halves of 32-bit floats.

    Callers use keys and array lengths that don't grow with the input.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            for key, block, cells in zip(*(batch.column(i).to_pylist() for i in range(3))):
                values = lengthened(cells) if short else np.frombuffer(cells, dtype)
                if (key, block) in sums:
                    combine(sums[key, block], values, out=sums[key, block])
                else:
                    sums[key, block] = values.copy()
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in sums]), pa.array([b for _, b in sums], pa.int32()), pa.array([v.tobytes() for v in sums.values()])],
                names=["key", "block", "cells"],
            )

    found: dict[str, dict[int, np.ndarray]] = {}
    for row in rows.repartition("key", "block").mapInArrow(add, ARRAY_SCHEMA).collect():
        found.setdefault(row["key"], {})[row["block"]] = np.frombuffer(row["cells"], dtype)
    out = {}
    for key, blocks in found.items():
        out[key] = np.zeros(BLOCK_CELLS * (max(blocks) + 1), dtype)
        for block, values in blocks.items():
            out[key][block * BLOCK_CELLS : block * BLOCK_CELLS + len(values)] = values
    return out


def shortened(values: np.ndarray) -> np.ndarray:
    """The upper halves of 32-bit floats: eight bits of precision, half the bytes."""
    return (np.ascontiguousarray(values, np.float32).view(np.uint32) >> np.uint32(16)).astype(np.uint16)


def lengthened(cells: bytes) -> np.ndarray:
    return (np.frombuffer(cells, np.uint16).astype(np.uint32) << np.uint32(16)).view(np.float32)


def fill(values: np.ndarray | None, length: int, dtype: str) -> np.ndarray:
    """An array of the given length; what is missing is zero."""
    out = np.zeros(length, dtype)
    if values is not None:
        out[: min(length, len(values))] = values[:length]
    return out


def array_batch(rows: list[tuple[str, int, bytes]]) -> pa.RecordBatch:
    keys, blocks, cells = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(blocks, pa.int32()), pa.array(cells, pa.binary())], names=["key", "block", "cells"])


# --- membership -------------------------------------------------------------------------------

FILTER_BITS = (1 << 20, 1 << 27)


def _filter_places(values: np.ndarray, bits: int) -> list[np.ndarray]:
    hashed = mix(values.astype(np.int64).view(np.uint64))
    return [((hashed >> np.uint64(shift)) & np.uint64(bits - 1)).astype(np.int64) for shift in (0, 32)]


def key_filter(keys: DataFrame, rows: int) -> np.ndarray:
    """A Bloom filter (packed bits) of a column of longs. Its size is bounded: with too many keys it lets more rows
    through to the exact join that follows, and never loses one."""
    bits = min(max(FILTER_BITS[0], 1 << (16 * max(rows, 1)).bit_length()), FILTER_BITS[1])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(bits, bool)
        for batch in batches:
            for places in _filter_places(batch.column(0).to_numpy(zero_copy_only=False), bits):
                found[places] = True
        if found.any():
            yield array_batch(list(array_rows("", np.packbits(found, bitorder="little"))))

    return fill(sum_arrays(keys.mapInArrow(mark, ARRAY_SCHEMA), "uint8", np.bitwise_or).get(""), bits // 8, "uint8")


def may_hold(packed: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each long whether the filter may hold it."""
    found = np.ones(len(values), bool)
    for places in _filter_places(values, len(packed) * 8):
        found &= (packed[places >> 3] >> (places & 7).astype(np.uint8)) & 1 == 1
    return found
