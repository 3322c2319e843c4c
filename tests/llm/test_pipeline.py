"""The stages against brute force, one after another, and as a whole; the queries are registered."""

import re
import zlib
from collections import Counter

import numpy as np

import __spark_entry__ as entry
import corpus_pipeline
from sievebase.llm import quality_rules
from sievebase.llm.common import materialize, vocabulary_file

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = {k: k + 32 for k in range(65, 91)}


def test_queries_are_registered():
    names = entry.queries()
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names and set(entry.oracle_sql()) <= set(names)


def test_stages(spark, sf_dir, documents):
    from tokenizers import Tokenizer

    docs, seen = documents, []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
        seen.append(docs)
    rules, copies, clean, mixed, tokens = seen
    for step in (rules, copies, clean, mixed):
        assert step.columns == documents.columns

    kept = {r.doc_id for r in quality_rules.quality_rules(documents).filter("kept").collect()}
    assert Counter(r.doc_id for r in rules.collect()) == Counter(kept)

    texts = {r.doc_id: r.text for r in rules.collect()}
    sets = {}
    for d, t in texts.items():
        w = WORD.findall(t.translate(LOWER))
        sets[d] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and (shared := len(sets[a] & sets[b])) and 100 * shared >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert {r.doc_id for r in copies.collect()} == {root(d) for d in sets}

    norm = lambda t: re.sub(r"[\W_]+", " ", t.lower()).strip()
    items = [norm(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    before, after = {r.doc_id: r.text for r in copies.collect()}, {r.doc_id for r in clean.collect()}
    leaks = {d for d, t in before.items() if any(i in norm(t) for i in items)}
    assert after <= set(before) - leaks and len(set(before) - leaks - after) <= 1

    words = {r.doc_id: len(WORD.findall(r.text)) for r in clean.collect()}
    taken = Counter(r.doc_id for r in mixed.collect())
    assert set(taken) <= after and max(taken.values()) <= 3
    total = sum(words.values())
    assert total - max(words.values()) <= sum(words[d] * n for d, n in taken.items()) <= total

    tokenizer = Tokenizer.from_file(vocabulary_file())
    want, start = [], 0
    for r in mixed.orderBy("doc_id").collect():
        ids = [*tokenizer.encode(r.text, add_special_tokens=False).ids, 2]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in tokens.orderBy("start").collect()] == want


def test_stages_of_dirty_and_empty_rows(spark, sf_dir, dirty, empty):
    for table in (dirty, empty):
        docs = table
        for name, stage in corpus_pipeline.STAGES:
            docs = materialize(stage(spark, docs, sf_dir), name)
        assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
