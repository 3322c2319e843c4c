"""Token ids in files coded by a static range asymmetric numeral system.

Texts are sorted by doc_id over range partitions. Each task encodes its texts to
ids, gathers them to segments of about four million ids that end at a document,
and codes a segment in one go: one frequency table, shared by the segment's
blocks; every block is coded on its own with ``LANES`` interleaved states. A
segment is a row of a Parquet file, so any store that Spark reaches will do, and a
lost task is simply run again.

Row format (all numbers little-endian):

* ``segment``: place in the order of all segments; ``n_ids``, ``n_docs``
* ``doc_ids`` int64, ``doc_known`` uint8 (0: null), ``doc_sizes`` uint32 (ids of each document, end id included)
* ``symbols`` uint16 and ``frequencies`` uint32, which add up to 2**18
* ``blocks``: of each ``n`` ids, ``first`` (checkpoint: ids of the segment before it), ``states`` (LANES x uint64),
  ``words`` (uint32 in the order of decoding), ``check`` (crc32 of states and words), ``ids_check`` (crc32 of the ids as uint16)

The decoder checks both sums of each block; blocks can be decoded in any order or
at once, and a document is found from ``doc_sizes`` and ``first``.

Texts are cut to pieces by the vocabulary's own pattern, on whole arrays of code
points, and the tokenizers library encodes each distinct piece once per worker:
pieces never share a token, so the ids equal those of the whole text. Added tokens of
the vocabulary are cut out first and keep their own ids, as the library has it.

Defined cases: a null or empty text has the end id alone; a null doc_id comes
first; equal doc_ids are ordered by a hash of their text; equal rows stay; an empty
table gives empty files and an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sievebase.llm.common import chunks, span_hashes
from sievebase.session import scratch_dir

END_ID = 2
SEGMENT_IDS = 1 << 22
BLOCK_IDS = 1 << 16
LANES = 32
SCALE_BITS = 18
LOW_STATE = np.uint64(1 << 31)
CACHE_PIECES = 3_000_000
PART_PIECES = 1_000_000
SLOT_BITS = 22  # places of the table that finds pieces by hash
JOINED = 2000  # new pieces in one text for the library

BLOCK = T.StructType(
    [
        T.StructField("n", T.LongType()), T.StructField("first", T.LongType()), T.StructField("states", T.BinaryType()),
        T.StructField("words", T.BinaryType()), T.StructField("check", T.LongType()), T.StructField("ids_check", T.LongType()),
    ]
)
SEGMENT = T.StructType(
    [
        T.StructField("segment", T.LongType()), T.StructField("n_ids", T.LongType()), T.StructField("n_docs", T.LongType()),
        T.StructField("doc_ids", T.BinaryType()), T.StructField("doc_known", T.BinaryType()), T.StructField("doc_sizes", T.BinaryType()),
        T.StructField("symbols", T.BinaryType()), T.StructField("frequencies", T.BinaryType()), T.StructField("blocks", T.ArrayType(BLOCK)),
    ]
)


# --- pieces -----------------------------------------------------------------------------------

SPACE, BLANK, LETTER, NUMBER, OTHER = range(5)
_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    """The class of every code point: the space, other white space, letters, numbers, the rest."""
    if not _classes:
        import regex

        everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        table = np.full(0x110000, OTHER, np.uint8)
        for pattern, value in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", BLANK)):
            found = "".join(regex.findall(pattern, everything))
            table[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = value
        table[0x1C:0x20] = OTHER  # not white space by Unicode's property
        table[0x20] = SPACE
        _classes.append(table)
    return _classes[0]


def piece_starts(points: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Where the pieces of texts begin, as flags over code points (one more than there are); edges: ends and starts of texts.

    Letters, numbers and other signs form runs, each with one space before it if
    there is one; the rest of a white run is a piece of its own, as is a last
    white character that is no space. An apostrophe that begins a piece takes
    s, t, m, d, re, ve or ll with it.
    """
    n = len(points)
    kind = classes()[points]
    group = np.where(kind == SPACE, BLANK, kind)
    edge = np.zeros(n + 3, bool)
    edge[edges] = True
    starts = edge[: n + 1].copy()
    starts[1:n] |= group[1:] != group[:-1]
    starts[n] = True
    # The last of a white run that something follows in the same text.
    last = np.flatnonzero((group[:-1] == BLANK) & (group[1:] != BLANK) & ~edge[1:n]) if n else np.zeros(0, int)
    starts[last] = True
    starts[last[points[last] == 0x20] + 1] = False
    quote = np.flatnonzero((points == 0x27) & starts[:n])
    if len(quote):
        padded = np.concatenate([points, np.zeros(3, points.dtype)])
        one, two = padded[quote + 1], padded[quote + 2]
        inside = ~edge[quote + 1]
        short = inside & np.isin(one, [ord(c) for c in "stmd"])
        pairs = [(ord(a), ord(b)) for a, b in ("re", "ve", "ll")]
        long_ = inside & ~edge[quote + 2] & np.logical_or.reduce([(one == a) & (two == b) for a, b in pairs])
        starts[quote[short | long_] + 1] = False
        starts[quote[short] + 2] = True
        starts[quote[long_] + 3] = True
    return starts


class Encoder:
    """Texts to ids; distinct pieces are encoded by the library once and kept up to a bound."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        added = self.tokenizer.get_added_tokens_decoder().values()
        if any(t.lstrip or t.rstrip or t.single_word for t in added):
            raise ValueError("added tokens that take in their surroundings are not supported")
        found = sorted((t.content.encode() for t in added), key=lambda t: (-len(t), t))
        self.added = re.compile(b"|".join(map(re.escape, found))) if found else None
        self.line_end = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.clear()

    def _added_spans(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
        """Where added tokens stand, the longest at each place, inside single texts."""
        whole = data.tobytes()
        if self.added is None or not self.added.search(whole):
            return []
        bounds = zip(offsets.tolist(), offsets[1:].tolist())
        return [(a + m.start(), a + m.end()) for a, b in bounds for m in self.added.finditer(whole[a:b])]

    def clear(self) -> None:
        self.slot_key, self.slot_place = np.zeros(1 << SLOT_BITS, np.uint64), np.full(1 << SLOT_BITS, -1, np.int32)
        self.ids, self.first, self.size = np.zeros(1 << 16, np.uint16), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)
        self.used = self.pieces = 0

    def _found(self, hashes: np.ndarray) -> np.ndarray:
        """The place in the store of each piece by its hash, -1 for those that are not there: a table with linear probing."""
        slot = (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        place, todo = np.full(len(hashes), -1, np.int32), np.arange(len(hashes))
        while len(todo):
            at = slot[todo]
            there = self.slot_place[at]
            same = (there >= 0) & (self.slot_key[at] == hashes[todo])
            place[todo[same]] = there[same]
            todo = todo[(there >= 0) & ~same]
            slot[todo] = (slot[todo] + 1) & ((1 << SLOT_BITS) - 1)
        return place

    def _keep(self, keys: np.ndarray) -> None:
        """Take distinct new hashes into the table, with the next places."""
        slot = (keys >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            free = todo[self.slot_place[slot[todo]] < 0]
            at, one = np.unique(slot[free], return_index=True)
            self.slot_key[at], self.slot_place[at] = keys[free[one]], self.pieces + free[one]
            done = np.zeros(len(keys), bool)
            done[free[one]] = True
            todo = todo[~done[todo]]
            slot[todo] = (slot[todo] + 1) & ((1 << SLOT_BITS) - 1)
        self.pieces += len(keys)

    def _learn(self, keys: np.ndarray, data: np.ndarray, begin: np.ndarray, end: np.ndarray, white: np.ndarray) -> None:
        """Encode new pieces and keep their ids at the end of the store.

        Pieces that are no white space go to the library as lines of longer texts, which cost it less than texts of their own.
        """
        lengths = end - begin + 1
        lines = np.flatnonzero(~white) if len(self.line_end) == 1 else np.zeros(0, int)
        upto = np.concatenate([[0], np.cumsum(lengths[lines])])
        spread = np.repeat(begin[lines] - upto[:-1], lengths[lines]) + np.arange(upto[-1])
        text = data[np.minimum(spread, len(data) - 1)]
        text[upto[1:] - 1] = 10
        cuts = upto[np.append(np.arange(0, len(lines), JOINED), len(lines))].tolist() if len(lines) else []
        texts = [text[x:y].tobytes().decode("utf-8") for x, y in zip(cuts, cuts[1:])]
        flat = [np.array(done.ids, np.uint16) for done in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        flat = np.concatenate(flat) if flat else np.zeros(0, np.uint16)
        ends = np.flatnonzero(flat == self.line_end[0])
        if len(ends) != len(lines):
            lines, flat, ends = lines[:0], flat[:0], ends[:0]
        sizes = np.diff(np.concatenate([[-1], ends])) - 1
        flat = flat[flat != self.line_end[0]] if len(lines) else flat
        alone = np.setdiff1d(np.arange(len(keys)), lines)
        rest = [data[begin[k] : end[k]].tobytes().decode("utf-8") for k in alone.tolist()]
        rest = [done.ids for done in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)]
        order = np.concatenate([lines, alone])
        sizes = np.concatenate([sizes, np.fromiter(map(len, rest), np.int64, len(rest))])
        flat = np.concatenate([flat, np.fromiter((i for ids in rest for i in ids), np.uint16)])
        n, first, total = self.pieces, self.used, len(flat)
        while n + len(keys) > len(self.first):
            self.first, self.size = np.concatenate([self.first, self.first]), np.concatenate([self.size, self.size])
        while first + total > len(self.ids):
            self.ids = np.concatenate([self.ids, self.ids])
        self.ids[first : first + total] = flat
        self.size[n + order] = sizes
        self.first[n + order] = first + np.cumsum(sizes) - sizes
        self.used = first + total
        self._keep(keys)

    def _places(self, hashes: np.ndarray, data: np.ndarray, cuts: np.ndarray, white: np.ndarray) -> np.ndarray:
        """The place in the store of each piece."""
        place = self._found(hashes)
        missing = np.flatnonzero(place < 0)
        if len(missing):
            keys, where = np.unique(hashes[missing], return_index=True)
            if self.pieces + len(keys) > CACHE_PIECES and self.pieces:
                self.clear()
                return self._places(hashes, data, cuts, white)
            at = missing[where]
            self._learn(keys, data, cuts[at], cuts[at + 1], white[at])
            place[missing] = self._found(hashes[missing])
        return place

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, each with the end id, and the number of ids of each text."""
        rows = len(offsets) - 1
        begins = np.flatnonzero((data & 0xC0) != 0x80)
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        edges = np.searchsorted(begins, offsets)
        spans = np.searchsorted(begins, np.array(self._added_spans(data, offsets), np.int64).reshape(-1, 2))
        flags = piece_starts(points, np.concatenate([edges, spans.reshape(-1)]))
        for a, b in spans.tolist():
            flags[a + 1 : b] = False
        starts = np.flatnonzero(flags[: len(points)])
        cuts = np.append(begins[starts], len(data)).astype(np.int64)
        white = classes()[points[np.append(starts[1:], len(points)) - 1]] <= BLANK if len(starts) else np.zeros(0, bool)
        hashes = span_hashes(data, cuts[:-1], cuts[1:])
        size, flat = np.zeros(len(hashes), np.int64), [np.zeros(0, np.uint16)]
        # A part has fewer pieces than the store holds.
        for k in range(0, len(hashes), PART_PIECES):
            part = slice(k, min(k + PART_PIECES, len(hashes)))
            place = self._places(hashes[part], data, cuts[k : part.stop + 1], white[part])
            size[part] = self.size[place]
            upto = np.concatenate([[0], np.cumsum(size[part])])
            flat.append(self.ids[np.repeat(self.first[place] - upto[:-1], size[part]) + np.arange(upto[-1])])
        flat, upto = np.concatenate(flat), np.concatenate([[0], np.cumsum(size)])
        ends = upto[np.searchsorted(starts, edges[1:])]
        sizes = np.diff(np.concatenate([[0], ends])) + 1
        out = np.full(len(flat) + rows, END_ID, np.uint16)
        keep = np.ones(len(out), bool)
        keep[np.cumsum(sizes) - 1] = False
        out[keep] = flat
        return out, sizes


# --- coding -----------------------------------------------------------------------------------


def frequency_table(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to add up to 2**SCALE_BITS, at least 1 where a symbol occurs."""
    total, whole = int(counts.sum()), 1 << SCALE_BITS
    scaled = np.where(counts > 0, np.maximum(1, counts.astype(np.int64) * whole // max(total, 1)), 0)
    spare = whole - int(scaled.sum())
    order = np.argsort(-counts, kind="stable")
    if spare >= 0:
        scaled[order[0]] += spare
    for k in order:  # the commonest give back what rare ones were lifted by
        if spare >= 0:
            break
        give = min(-spare, int(scaled[k]) // 2)
        scaled[k] -= give
        spare += give
    return scaled


def encode_blocks(ids: np.ndarray, freq: np.ndarray) -> list[dict]:
    """Code ids in blocks; all lanes of all blocks advance together, from the last id to the first."""
    n = len(ids)
    blocks = max(1, -(-n // BLOCK_IDS))
    per = -(-n // (blocks * LANES)) * LANES
    padded = np.full(blocks * per, END_ID, np.int64)
    padded[:n] = ids
    steps = padded.reshape(blocks, per // LANES, LANES).transpose(1, 0, 2).reshape(per // LANES, blocks * LANES)
    start = (np.cumsum(freq) - freq).astype(np.uint64)
    freq = freq.astype(np.uint64)
    x = np.full(blocks * LANES, LOW_STATE, np.uint64)
    words, owners = [], []
    for t in range(len(steps) - 1, -1, -1):
        f, c = freq[steps[t]], start[steps[t]]
        full = np.flatnonzero(x >= f << np.uint64(63 - SCALE_BITS))[::-1]
        words.append(x[full].astype(np.uint32))
        owners.append(full // LANES)
        x[full] >>= np.uint64(32)
        q = x // f
        x = (q << np.uint64(SCALE_BITS)) + (x - q * f) + c
    words, owners = np.concatenate(words)[::-1], np.concatenate(owners)[::-1]
    words = words[np.argsort(owners, kind="stable")]
    cuts = np.concatenate([[0], np.cumsum(np.bincount(owners, minlength=blocks))])
    out = []
    for b in range(blocks):
        states, own = x[b * LANES : (b + 1) * LANES].astype("<u8").tobytes(), words[cuts[b] : cuts[b + 1]].astype("<u4").tobytes()
        part = ids[b * per : (b + 1) * per]
        out.append(
            {"n": len(part), "first": b * per, "states": states, "words": own, "check": zlib.crc32(own, zlib.crc32(states)), "ids_check": zlib.crc32(part.astype("<u2").tobytes())}
        )
    return out


def decode_blocks(blocks: list[dict], symbols: np.ndarray, frequencies: np.ndarray) -> np.ndarray:
    """The ids of blocks of one table; a wrong checksum is an error. Blocks with a like number of ids are decoded together."""
    frequencies = frequencies.astype(np.uint64)
    of_slot = np.repeat(np.arange(len(symbols)), frequencies.astype(np.int64))
    start = np.cumsum(frequencies) - frequencies
    for b in blocks:
        if zlib.crc32(b["words"], zlib.crc32(b["states"])) != b["check"]:
            raise ValueError("a block's bytes are damaged")
    count = len(blocks)
    steps = -(-max(b["n"] for b in blocks) // LANES)
    x = np.concatenate([np.frombuffer(b["states"], "<u8") for b in blocks]).astype(np.uint64)
    streams = [np.frombuffer(b["words"], "<u4") for b in blocks]
    ends = np.cumsum([len(s) for s in streams])
    stream = np.concatenate([*streams, np.zeros(1, "<u4")]).astype(np.uint64)
    at = ends - [len(s) for s in streams]
    limit = len(stream) - 1
    out = np.empty((steps, count * LANES), np.uint16)
    mask = np.uint64((1 << SCALE_BITS) - 1)
    for t in range(steps):
        slot = x & mask
        s = of_slot[slot.astype(np.int64)]
        out[t] = symbols[s]
        x = frequencies[s] * (x >> np.uint64(SCALE_BITS)) + slot - start[s]
        low = (x < LOW_STATE).reshape(count, LANES)
        turn = np.cumsum(low, 1)
        where = np.flatnonzero(low)
        x[where] = (x[where] << np.uint64(32)) | stream[np.minimum((at[:, None] + turn - 1).reshape(-1)[where], limit)]
        at = at + turn[:, -1]
    ids = out.reshape(steps, count, LANES).transpose(1, 0, 2).reshape(count, steps * LANES)
    parts = [ids[k, : b["n"]] for k, b in enumerate(blocks)]
    for part, b in zip(parts, blocks):
        if zlib.crc32(part.astype("<u2").tobytes()) != b["ids_check"]:
            raise ValueError("a block's ids are damaged")
    return np.concatenate(parts)


# --- files ------------------------------------------------------------------------------------

_encoders: dict[str, Encoder] = {}


def encoder_of(vocabulary: str) -> Encoder:
    """The encoder that a worker process keeps from task to task. Tasks reach it by this function's name: a dictionary that
    they refer to themselves would be sent along, empty, with each of them."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]


def _segment(number: int, ids: np.ndarray, doc_ids: list[int | None], sizes: np.ndarray) -> dict:
    counts = np.bincount(ids, minlength=END_ID + 1)
    counts[END_ID] = max(counts[END_ID], 1)
    freq = frequency_table(counts)
    symbols = np.flatnonzero(freq)
    return {
        "segment": number, "n_ids": len(ids), "n_docs": len(doc_ids),
        "doc_ids": np.array([d or 0 for d in doc_ids], "<i8").tobytes(), "doc_known": np.array([d is not None for d in doc_ids], np.uint8).tobytes(),
        "doc_sizes": sizes.astype("<u4").tobytes(), "symbols": symbols.astype("<u2").tobytes(), "frequencies": freq[symbols].astype("<u4").tobytes(),
        "blocks": encode_blocks(ids, freq),
    }


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def write_token_files(docs: DataFrame, path: str, vocabulary: str) -> None:
    """Write the ids of all texts in ascending doc_id order; ``vocabulary`` is a tokenizer file that all executors have."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(vocabulary)
        number, schema = TaskContext.get().partitionId() << 24, _arrow_schema(SEGMENT)
        ids, doc_ids, sizes, held = [], [], [], 0

        def emit() -> pa.RecordBatch:
            row = _segment(number, np.concatenate(ids), doc_ids, np.concatenate(sizes))
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for rows, data, offsets in chunks(batches):
            part, part_sizes = encoder.encode(data, offsets)
            ids.append(part)
            sizes.append(part_sizes)
            doc_ids += rows.column(0).to_pylist()
            held += len(part)
            if held >= SEGMENT_IDS:
                yield emit()
                number += 1
                ids, doc_ids, sizes, held = [], [], [], 0
        if held:
            yield emit()

    # Many rows may have one doc_id, or none.
    keys = ["doc_id", "_hash", "_tie"]
    placed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_hash"), F.monotonically_increasing_id().alias("_tie"))
    ordered = placed.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ordered.select("doc_id", "text").mapInArrow(encode, SEGMENT).write.parquet(path)


def read_token_files(df: DataFrame) -> DataFrame:
    """Decode segments: (segment, doc_id, at, n_tokens, ids_crc32); ``at`` counts the segment's ids before the document."""
    schema = "segment long, doc_id long, at long, n_tokens long, ids_crc32 long"

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode_blocks(row["blocks"], np.frombuffer(row["symbols"], "<u2"), np.frombuffer(row["frequencies"], "<u4"))
                sizes = np.frombuffer(row["doc_sizes"], "<u4").astype(np.int64)
                ends, wide = np.cumsum(sizes), ids.astype("<u4")
                sums = [zlib.crc32(wide[e - n : e]) for e, n in zip(ends, sizes)]
                known = np.frombuffer(row["doc_known"], np.uint8) == 0
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(sizes), row["segment"])), pa.array(np.frombuffer(row["doc_ids"], "<i8"), mask=known),
                        pa.array(ends - sizes), pa.array(sizes), pa.array(sums, pa.int64()),
                    ],
                    names=["segment", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    return df.mapInArrow(decode, schema)


def token_files(docs: DataFrame, vocabulary: str, path: str | None = None) -> DataFrame:
    """Write the files, read them back, and give per document: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = path or scratch_dir(spark, "token-ids")
    write_token_files(docs, path, vocabulary)
    files = spark.read.schema(SEGMENT).parquet(path)
    ahead = F.sum("n_ids").over(Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1))
    base = files.select("segment", "n_ids").select("segment", F.coalesce(ahead, F.lit(0)).alias("base"))
    return read_token_files(files).join(base, "segment").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
