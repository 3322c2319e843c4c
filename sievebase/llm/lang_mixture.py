"""Language identification by multilingual mixture inference.

From labelled documents each language gets a table of hashed byte trigrams (A-Z
lowered, with the gap before a word). A document is a mixture: each word comes
from one language, with the likelihood that the language's trigrams give it.
Expectation-maximisation finds the document's language proportions. Then the
languages with the largest proportions form nested sets; each set is fitted
again, and the one with the best likelihood, less half the logarithm of the
number of words for each further language, is the document's set. The prediction
is the set's largest share; its score is that language's proportion among all.

Defined cases: null text or text without a letter gives ``und`` and score 0, and
no languages; a null language or text isn't learned from; without any labelled
document every text is ``und``; ties go to the language first by code point;
equal rows are scored alike; an empty table gives an empty result; whole texts
are used whatever their length; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievebase.llm.common import ARRAY_SCHEMA, IS_SPACE, LOWER, array_batch, array_rows, chunks, fill, sum_arrays, word_bounds

CELLS = 1 << 16
SMOOTHING = 0.5
ROUNDS = 12
REFIT_ROUNDS = 6
LEAST_SHARE = 1e-6


def held_out(doc_id: Column, parts: int) -> Column:
    """Whether crc32 of the id's text leaves no remainder; a null id counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % parts == 0


def trigram_cells(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each byte the cell of the trigram that ends there; CELLS for white space. Texts are kept apart."""
    lowered = LOWER[data]
    gap = IS_SPACE[data]
    lowered[gap] = 0x20
    one, two = np.full(len(data), 0x20, np.uint32), np.full(len(data), 0x20, np.uint32)
    one[1:] = lowered[:-1]
    firsts = offsets[:-1][offsets[:-1] < len(data)]
    one[firsts] = 0x20
    two[1:] = one[:-1]
    two[one == 0x20] = 0x20
    code = (two << np.uint32(16)) | (one << np.uint32(8)) | lowered
    cells = ((code * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int32)
    cells[gap] = CELLS
    return cells


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in code point order and log10-free log probabilities (languages x CELLS + 1) from columns lang and text.

    The tables have a fixed size per language; counts cover every given document.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for rows, data, offsets in chunks(batches):
            langs = rows.column(0).dictionary_encode()
            of_row = np.repeat(langs.indices.to_numpy(), np.diff(offsets))
            cells = trigram_cells(data, offsets)
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                own = np.bincount(cells[of_row == k], minlength=CELLS + 1)[:CELLS]
                sums[lang] = sums.get(lang, 0) + own
        found = [r for lang, values in sums.items() for r in array_rows(lang, values.astype(np.int64))]
        if found:
            yield array_batch(found)

    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    counts = sum_arrays(known.mapInArrow(count, ARRAY_SCHEMA), "int64")
    langs = sorted(counts, key=lambda x: x.encode())
    tables = np.zeros((len(langs), CELLS + 1), np.float32)
    for k, lang in enumerate(langs):
        c = fill(counts[lang], CELLS, "int64") + SMOOTHING
        tables[k, :CELLS] = np.log(c / c.sum())
    return langs, tables


def proportions(like: np.ndarray, before: np.ndarray, shares: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation for many texts: like (words x languages, scaled), shares (texts x languages) to start from.

    Gives the shares and each text's log likelihood under them (less the words' scales). Every text has a word.
    """
    of_word = np.repeat(np.arange(len(shares)), np.diff(before))
    n = np.diff(before)[:, None]
    for _ in range(rounds):
        joint = like * shares[of_word]
        joint /= joint.sum(1, keepdims=True)
        shares = np.maximum(np.add.reduceat(joint, before[:-1], axis=0) / n, LEAST_SHARE * (shares > 0))
        shares /= shares.sum(1, keepdims=True)
    total = np.log((like * shares[of_word]).sum(1))
    return shares, np.add.reduceat(total, before[:-1])


def infer(data: np.ndarray, offsets: np.ndarray, tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions among all languages, and proportions in the chosen set (zero outside), texts x languages.

    Texts without words have zeros.
    """
    n, langs = len(offsets) - 1, len(tables)
    full, chosen = np.zeros((n, langs)), np.zeros((n, langs))
    starts, _, before = word_bounds(data, offsets)
    some = np.flatnonzero(np.diff(before) > 0)
    if not len(some) or not langs:
        return full, chosen
    cells = trigram_cells(data, offsets)
    like = np.stack([np.add.reduceat(table[cells], starts) for table in tables], 1).astype(np.float32)
    like = np.exp(np.maximum(like - like.max(1, keepdims=True), -60))
    before = before[np.append(some, n)]
    words = np.diff(before)
    shares, _ = proportions(like, before, np.full((len(some), langs), 1 / langs, np.float32), ROUNDS)
    full[some] = shares
    order = np.argsort(-shares, axis=1, kind="stable")
    best, fitted = np.full(len(some), -np.inf), np.zeros_like(shares)
    for k in range(1, langs + 1):
        start = np.zeros_like(shares)
        np.put_along_axis(start, order[:, :k], np.take_along_axis(shares, order[:, :k], 1), 1)
        own, likelihood = proportions(like, before, start / start.sum(1, keepdims=True), REFIT_ROUNDS if k > 1 else 0)
        value = likelihood - 0.5 * (k - 1) * np.log(words)
        better = value > best
        fitted[better], best[better] = own[better], value[better]
    chosen[some] = fitted
    return full, chosen


def identify(docs: DataFrame, langs: list[str], tables: np.ndarray) -> DataFrame:
    """Per document: doc_id, lang_pred, score, langs (array) and shares (array) of the chosen set, largest first."""
    names = np.array(langs, object)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in chunks(batches):
            full, chosen = infer(data, offsets, tables)
            lettered = rows.column(2).to_numpy(zero_copy_only=False).astype(bool)
            pred, scores, sets, shares = [], [], [], []
            for has, own, all_ in zip(lettered, chosen, full):
                order = [k for k in np.argsort(-own, kind="stable") if own[k] > 0] if has else []
                pred.append(names[order[0]] if order else "und")
                scores.append(min(1.0, float(all_[order[0]])) if order else 0.0)
                sets.append([names[k] for k in order])
                shares.append([float(own[k]) for k in order])
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(pred, pa.string()), pa.array(scores, pa.float64()), pa.array(sets, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))],
                names=["doc_id", "lang_pred", "score", "langs", "shares"],
            )

    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered")
    schema = "doc_id long, lang_pred string, score double, langs array<string>, shares array<double>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", lettered).mapInArrow(score, schema)
