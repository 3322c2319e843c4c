"""Shards cut from a Hilbert curve over several metadata dimensions.

Language, source, text size and doc_id are each quantised to 32 levels at their
own quantiles (a name stands for the number of rows with lesser names, so whole
names decide), the cell's index on the four-dimensional Hilbert curve is the sort
key, and the sorted rows are cut into runs of equal length. Neighbours on the
curve are neighbours in every dimension, so the minimum and maximum statistics of
a shard's files are narrow in all of them at once, and a filter on any dimension
skips most files.

The global position of a row comes from quantile slices of the key (bounded in
number), their running count, and a row number inside each slice. The key ends in
a hash of doc_id, so a cell that holds a third of all rows is spread over many
slices.

Law: ``rows``, the numbers of rows of two shards differ by one at most.

Defined cases: a null text has no bytes and the crc32 of an empty text; a null
dimension is the level below all others; equal rows are placed separately, ties
of equal key by doc_id; an empty table gives an empty result; input columns named
like result columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievebase.llm.common import materialize

N_SHARDS = 40
ROW_BYTES = 16
LEVEL_BITS = 5
SLICES = 1024
HASH_BITS = 40
DIMENSIONS = ("_lang", "_source", "_bytes", "_id")


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of integer cells (rows by dimensions), all rows at once.

    Gray-code form: from the highest bit down, exchange or invert the lower bits
    of the axes, then undo the Gray code over the interleaved bits.
    """
    x = cells.astype(np.int64).copy()
    dims = x.shape[1]
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for d in range(dims):
            one = (x[:, d] >> bit) & 1 == 1
            swap = np.where(one, 0, (x[:, 0] ^ x[:, d]) & low)
            x[:, 0] ^= np.where(one, low, swap)
            x[:, d] ^= swap
    for d in range(1, dims):
        x[:, d] ^= x[:, d - 1]
    turn = np.zeros(len(x), np.int64)
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where((x[:, -1] >> bit) & 1 == 1, (1 << bit) - 1, 0)
    x ^= turn[:, None]
    index = np.zeros(len(x), np.int64)
    for bit in range(bits - 1, -1, -1):
        for d in range(dims):
            index = (index << 1) | ((x[:, d] >> bit) & 1)
    return index


def described(docs: DataFrame) -> DataFrame:
    """doc_id, size, crc32 and the four dimensions, two of them names; texts end here."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bytes_ = F.octet_length(text).cast("long")
    return docs.select(
        F.col("doc_id"), (bytes_ + ROW_BYTES).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.col("lang").alias("_lang"), F.col("source").alias("_source"), bytes_.alias("_bytes"), F.col("doc_id").alias("_id"),
    )


def ranked(rows: DataFrame) -> DataFrame:
    """Each name becomes the number of rows with lesser names; null stays null.

    Distinct names are counted and cut into ranges; the rank is the total of the
    ranges before and a running sum inside the name's range.
    """
    for name in ("_lang", "_source"):
        counts = rows.filter(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("_c"))
        counts = materialize(counts.repartitionByRange(name).withColumn("_part", F.spark_partition_id()), "names")
        parts = counts.groupBy("_part").agg(F.sum("_c").alias("_all"), F.min(name).alias("_least"))
        sums = lambda column, window: F.coalesce(F.sum(column).over(window), F.lit(0))
        ahead = parts.select("_part", sums("_all", Window.orderBy("_least").rowsBetween(Window.unboundedPreceding, -1)).alias("_ahead"))
        inside = sums("_c", Window.partitionBy("_part").orderBy(name).rowsBetween(Window.unboundedPreceding, -1))
        ranks = counts.withColumn("_inside", inside).join(ahead, "_part").select(name, (F.col("_ahead") + F.col("_inside")).alias("_rank"))
        rows = rows.join(materialize(ranks, "ranks"), name, "left").withColumn(name, F.col("_rank")).drop("_rank")
    return rows


def _quantiles(column: Column, n: int) -> Column:
    return F.percentile_approx(column, [k / n for k in range(1, n)], 20 * n)


def curve_keys(rows: DataFrame) -> DataFrame:
    """Add ``_key``: Hilbert index of the row's cell, then a hash of doc_id."""
    levels = 1 << LEVEL_BITS
    found = rows.agg(*[_quantiles(F.col(d), levels).alias(d) for d in DIMENSIONS]).first()
    bounds = {d: np.unique(np.array(found[d] or [], np.int64)) for d in DIMENSIONS}

    @F.pandas_udf("long")
    def index(lang: pd.Series, source: pd.Series, size: pd.Series, ident: pd.Series) -> pd.Series:
        cells = []
        for name, values in zip(DIMENSIONS, (lang, source, size, ident)):
            known = values.notna().to_numpy()
            # Doubles hold these numbers to a few units only, hence not float.
            level = np.searchsorted(bounds[name], values.fillna(0).astype("int64").to_numpy(), "right")
            cells.append(np.where(known, level, 0))
        return pd.Series(hilbert_index(np.stack(cells, 1), LEVEL_BITS))

    tie = F.xxhash64("doc_id").bitwiseAND((1 << HASH_BITS) - 1)
    return rows.withColumn("_key", F.shiftleft(index(*DIMENSIONS), HASH_BITS).bitwiseOR(tie))


def hilbert_shards(docs: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """Per document: doc_id, size, text_crc32, curve index, law, shard, slot."""
    rows = materialize(curve_keys(ranked(materialize(described(docs), "described"))).drop(*DIMENSIONS), "curve")
    found = rows.agg(_quantiles(F.col("_key"), SLICES).alias("q"), F.count("*").alias("n")).first()
    cuts, total = np.unique(np.array(found["q"] or [], np.int64)), found["n"]

    @F.pandas_udf("int")
    def slice_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, key.to_numpy(), "right").astype("int32"))

    sliced = rows.withColumn("_slice", slice_of("_key"))
    counts = sliced.groupBy("_slice").count()
    ahead = F.sum("count").over(Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_slice", F.coalesce(ahead, F.lit(0)).alias("_ahead"))
    inside = F.row_number().over(Window.partitionBy("_slice").orderBy("_key", "doc_id", "text_crc32", "size"))
    placed = sliced.withColumn("_n", inside).join(offsets, "_slice").withColumn("_at", F.col("_ahead") + F.col("_n") - 1)
    # Shard of position p: p * shards div rows; its first position is the least p that gives it.
    shard = F.expr(f"cast((_at * {n_shards}L) div {max(total, 1)}L as int)")
    first = F.expr(f"(cast(shard as bigint) * {total}L + {n_shards - 1}L) div {n_shards}L")
    placed = placed.withColumn("shard", shard).withColumn("slot", F.col("_at") - first)
    return placed.select(
        "doc_id", "size", "text_crc32", F.shiftright("_key", HASH_BITS).alias("curve_index"), F.lit("rows").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, shards: DataFrame, path: str) -> None:
    """Write whole documents as one folder per shard, in curve order; doc_id must be unique."""
    placed = docs.join(shards.select("doc_id", "curve_index", "shard", "slot"), "doc_id")
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
