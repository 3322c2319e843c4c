"""Language model scores from a hashed maximum-entropy model.

The probability of a token is that of its class in its context times that of the
token in its class. Classes are hashes of word endings; the end of a text is a
class of its own. The class model is a softmax over hashed features of the
context: the word before, the two words before (n-grams), and the second and third
word back (skips). In its class a token has its smoothed relative frequency, the
maximum-entropy solution for that one feature.

Training is by full gradients, so the model does not depend on how documents are
partitioned (up to the rounding of sums). The first one needs no model: it is that of
counts of (feature, class) against the classes' shares. In each round tasks sum what
the shared weights expect of each feature and class, and the weights move by a part of
the logarithm of observed over expected, as iterative scaling does. All training
documents are used in each round.

The number of hashed rows of a template grows with the counted vocabulary, from
2**LEAST_ROW_BITS to 2**MOST_ROW_BITS (so that a worker can hold the weights); every
task sums into arrays of that size, hence passes run in as many tasks as the cluster has
cores, each over a stream of documents.

Counts of all words are made by a shuffle. The commonest (at most ``COMMON``) go to
the tasks as sorted arrays; the other words of each document are joined to the
counts, so every count is exact whatever the vocabulary.

Defined cases: a null, empty or blank text has the end alone; a word never met in
training has count 0; without training documents every token has probability 1 in
the base score and its class's share in the model; a null doc_id is hashed as the
empty text; repeated rows are scored each, and trained on each; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievebase.llm.common import (
    ARRAY_SCHEMA, LOWER, array_batch, array_rows, chunks, fill, materialize, mix, span_hashes, sum_arrays, word_bounds,
)

CLASSES = 32
ENDING = 3
LEAST_ROW_BITS, MOST_ROW_BITS = 11, 14
WORDS_PER_ROW = 4
TEMPLATES = 4
BATCH = 1 << 12
ROUNDS = 2
FIRST_RATE, RATE = 0.45, 0.3
CAUTION = 30.0  # observations, spread like the classes' shares, that every feature is given
SMOOTHING = 0.1
COMMON = 1 << 19
END = np.uint64(0x2545F4914F6CDD1D)
BEFORE = np.uint64(0x9FB21C651E98DF25)


class Tokens(NamedTuple):
    """Tokens of texts one after another, each text closed by its end: hash, class, and tokens before each text."""

    words: np.ndarray
    classes: np.ndarray
    before: np.ndarray


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    lowered = LOWER[data]
    starts, ends, before = word_bounds(lowered, offsets)
    rows = len(offsets) - 1
    closed = before + np.arange(rows + 1)
    is_word = np.ones(len(starts) + rows, bool)
    is_word[closed[1:] - 1] = False
    words, classes = np.full(len(is_word), END, np.uint64), np.zeros(len(is_word), np.int16)
    words[is_word] = span_hashes(lowered, starts, ends)
    classes[is_word] = 1 + (span_hashes(lowered, np.maximum(starts, ends - ENDING), ends) % np.uint64(CLASSES - 1)).astype(np.int16)
    return Tokens(words, classes, closed)


def context_rows(tokens: Tokens, row_bits: int) -> np.ndarray:
    """For each token the weight row of each feature of its context (tokens x templates)."""
    n = len(tokens.words)
    back = [np.full(n, BEFORE, np.uint64) for _ in range(3)]
    place = np.arange(n) - np.repeat(tokens.before[:-1], np.diff(tokens.before))
    for k, earlier in enumerate(back, 1):
        inside = place >= k
        earlier[inside] = tokens.words[np.flatnonzero(inside) - k]
    one, two, three = back
    features = [one, mix(two * np.uint64(0xD1342543DE82EF95) + one), two, three]
    rows = [(mix(f + np.uint64(k)) >> np.uint64(64 - row_bits)).astype(np.int32) + (k << row_bits) for k, f in enumerate(features)]
    return np.stack(rows, 1)


def _scores(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of weights of all classes (tokens x classes), less the greatest of each token."""
    z = weights.take(rows[:, 0], 0)
    for k in range(1, TEMPLATES):
        z += weights.take(rows[:, k], 0)
    z += bias
    z -= z.max(1, keepdims=True)
    return z


def _row_sums(values: np.ndarray) -> np.ndarray:
    return values @ np.ones(values.shape[1], values.dtype)


def class_log_probs(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Natural log probabilities of all classes (tokens x classes)."""
    z = _scores(weights, bias, rows)
    return z - np.log(_row_sums(np.exp(z)))[:, None]


def own_log_probs(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Natural log probability of each token's class."""
    z = _scores(weights, bias, rows)
    own = z[np.arange(len(z)), classes]
    return own - np.log(_row_sums(np.exp(z, out=z)))


def add_expected(expected: np.ndarray, weights: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> None:
    """Add the probabilities of all classes to the rows of each token's features, in place."""
    chances = _scores(weights, bias, rows)
    np.exp(chances, out=chances)
    chances /= _row_sums(chances)[:, None]
    # Two floats are added as one complex number, which halves the steps of the indexed sum.
    pairs, sums = chances.view(np.complex64).ravel(), expected.reshape(-1).view(np.complex64)
    width = expected.shape[1] // 2
    for k in range(TEMPLATES):
        np.add.at(sums, (rows[:, k, None].astype(np.int64) * width + np.arange(width)).ravel(), pairs)


def scaled(weights: np.ndarray, observed: np.ndarray, expected: np.ndarray, share: np.ndarray, rate: float) -> np.ndarray:
    """Weights after a step: by the logarithm of observed over expected counts, both with CAUTION more by share."""
    more = CAUTION * share
    return (weights + rate * np.log((observed + more) / (expected + more))).astype(np.float32)


class Counts(NamedTuple):
    """The word counts of the training documents: a table (word, class, c), and totals by class."""

    table: DataFrame
    tokens: np.ndarray
    kinds: np.ndarray
    docs: int


def count_words(train: DataFrame) -> Counts:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, docs = [], 0, 0

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            words, classes, counts = (np.concatenate(x) for x in zip(*held))
            unique, first, of = np.unique(words, return_index=True, return_inverse=True)
            return unique, classes[first], np.bincount(of, counts).astype(np.int64)

        for _, data, offsets in chunks(batches):
            tokens = tokens_of(data, offsets)
            unique, first, counts = np.unique(tokens.words, return_index=True, return_counts=True)
            held.append((unique, tokens.classes[first], counts))
            size += len(unique)
            if size > 3_000_000:
                held = [merged()]
                size = len(held[0][0])
                if size > 2_000_000:
                    yield _rows(*held[0])
                    held, size = [], 0
        if held:
            yield _rows(*merged())

    def _rows(words: np.ndarray, classes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(classes.astype(np.int32)), pa.array(counts)], names=["word", "class", "c"])

    rows = train.select("text").mapInArrow(count, "word long, class int, c long")
    table = materialize(rows.groupBy("word", "class").agg(F.sum("c").alias("c")), "words")
    tokens, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in table.groupBy("class").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():
        tokens[r["class"]], kinds[r["class"]] = r["c"], r["v"]
    return Counts(table, tokens, kinds, int(tokens[0]))


def common_words(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The commonest words and their counts, sorted by word; COMMON at most."""
    bins = {r["b"]: r["count"] for r in table.groupBy(F.floor(F.log2("c")).cast("int").alias("b")).count().collect()}
    least, total = None, 0
    for b in sorted(bins, reverse=True):
        total += bins[b]
        if total > COMMON:
            break
        least = b
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0)
    found = table.filter(F.floor(F.log2("c")) >= least).select("word", "c").toArrow()
    words, counts = found.column("word").to_numpy(), found.column("c").to_numpy().astype(float)
    order = np.argsort(words)
    return words[order], counts[order]


class Model(NamedTuple):
    """Shared weights (features x classes), the bias, which is the classes' shares, and the bits of a template's rows."""

    weights: np.ndarray
    bias: np.ndarray
    row_bits: int


def row_bits(kinds: float) -> int:
    """Bits of a template's rows for so many distinct words."""
    return int(np.clip(np.ceil(np.log2(max(kinds, 1) / WORDS_PER_ROW)), LEAST_ROW_BITS, MOST_ROW_BITS))


def learn_weights(train: DataFrame, counts: Counts) -> Model:
    share = (counts.tokens + SMOOTHING) / (counts.tokens + SMOOTHING).sum()
    bias, bits = np.log(share).astype(np.float32), row_bits(counts.kinds.sum())
    shape = (TEMPLATES << bits, CLASSES)
    first = (np.arange(TEMPLATES) << bits).astype(np.int32)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offsets in chunks(batches):
            tokens = tokens_of(data, offsets)
            inside = (context_rows(tokens, bits) - first).astype(np.uint16)  # bits are 16 at most
            cuts = range(0, len(inside), BATCH)
            yield pa.RecordBatch.from_arrays(
                [pa.array([inside[a : a + BATCH].tobytes() for a in cuts], pa.binary()), pa.array([tokens.classes[a : a + BATCH].astype(np.uint8).tobytes() for a in cuts], pa.binary())],
                names=["places", "classes"],
            )

    # Every round reads the features of all tokens, so they are made once: ten bytes a token at most.
    held = materialize(train.select("text").mapInArrow(places, "places binary, classes binary"), "features")
    # As many tasks as cores: each gives arrays of the weights' size, however long its input.
    held = held.coalesce(train.sparkSession.sparkContext.defaultParallelism)

    def total(add, dtype: str) -> np.ndarray:  # noqa: ANN001
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(shape, dtype)
            for batch in batches:
                for inside, classes in zip(batch.column(0), batch.column(1)):
                    rows = np.frombuffer(inside.as_buffer(), np.uint16).reshape(-1, TEMPLATES) + first
                    add(sums, rows, np.frombuffer(classes.as_buffer(), np.uint8))
            for part in array_rows("sums", sums.ravel()):
                yield array_batch([part])

        return fill(sum_arrays(held.mapInArrow(run, ARRAY_SCHEMA), dtype).get("sums"), shape[0] * CLASSES, dtype).reshape(shape)

    def observe(sums: np.ndarray, rows: np.ndarray, classes: np.ndarray) -> None:
        np.add.at(sums.reshape(-1), (rows.astype(np.int64) * CLASSES + classes[:, None]).ravel(), sums.dtype.type(1))

    observed = total(observe, "int32").astype(np.float64)
    weights = scaled(np.zeros(shape, np.float32), observed, observed.sum(1, keepdims=True) * share, share, FIRST_RATE)
    for _ in range(ROUNDS):
        last = weights
        expected = total(lambda sums, rows, _: add_expected(sums, last, bias, rows), "float32")  # noqa: B023
        weights = scaled(weights, observed, expected, share, RATE)
    return Model(weights, bias, bits)


def score_documents(docs: DataFrame, held_out: Column, counts: Counts, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every document."""
    common, common_counts = common_words(counts.table)
    room = np.log10(counts.tokens + SMOOTHING * (counts.kinds + 1))
    known = np.log10(common_counts + SMOOTHING)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for rows, data, offsets in chunks(batches):
            tokens = tokens_of(data, offsets)
            n = len(offsets) - 1
            of = np.repeat(np.arange(n), np.diff(tokens.before))
            features = context_rows(tokens, model.row_bits)
            value = np.empty(len(of))
            for a in range(0, len(of), BATCH):
                part = slice(a, a + BATCH)
                value[part] = own_log_probs(model.weights, model.bias, features[part], tokens.classes[part])
            words = tokens.words.view(np.int64)
            at = np.minimum(np.searchsorted(common, words), max(len(common) - 1, 0))
            found = common[at] == words if len(common) else np.zeros(len(words), bool)
            logs = np.bincount(of[found], known[at[found]], n) if len(common) else np.zeros(n)
            fixed = np.bincount(of, value / np.log(10) - room[tokens.classes], n)
            lacking = np.flatnonzero(~found)
            order = lacking[np.lexsort((words[lacking], of[lacking]))]
            first = np.flatnonzero(np.concatenate([[True], (words[order][1:] != words[order][:-1]) | (of[order][1:] != of[order][:-1])])) if len(order) else order
            times = np.diff(np.append(first, len(order)))
            bounds = np.searchsorted(of[order][first], np.arange(n + 1)).astype(np.int32)
            listed = lambda x: pa.ListArray.from_arrays(pa.array(bounds), pa.array(x))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row + np.arange(n)), rows.column(0), rows.column(1), pa.array(np.diff(tokens.before)),
                    pa.array(np.bincount(of[found], minlength=n)), pa.array(logs), pa.array(fixed), listed(words[order][first]), listed(times.astype(np.int64)),
                ],
                names=["row", "doc_id", "held_out", "n_tokens", "found", "logs", "fixed", "rare", "times"],
            )
            row += n

    schema = "row long, doc_id long, held_out boolean, n_tokens long, found long, logs double, fixed double, rare array<long>, times array<long>"
    scored = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text").mapInArrow(run, schema), "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("row", F.col("r.rare").alias("word"), F.col("r.times").alias("t"))
    joined = rare.join(counts.table, "word", "left")
    extra = joined.groupBy("row").agg(
        F.sum(F.col("t") * F.log10(F.coalesce("c", F.lit(0)) + SMOOTHING)).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("t")).otherwise(0)).alias("met")
    )
    total, kinds = float(counts.tokens.sum()), float(counts.kinds.sum())
    logs = F.col("logs") + F.coalesce("more", F.lit(0.0))
    return scored.drop("rare", "times").join(extra, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("found") + F.coalesce("met", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * float(np.log10(total + SMOOTHING * (kinds + 1)))).alias("base_score"), (logs + F.col("fixed")).alias("score"),
    )


def score(docs: DataFrame, held_out: Column) -> DataFrame:
    """Learn from the documents that aren't held out, and score all."""
    train = docs.filter(~held_out)
    counts = count_words(train)
    return score_documents(docs, held_out, counts, learn_weights(train, counts))
