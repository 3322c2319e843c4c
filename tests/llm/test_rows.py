"""Quality rules, source mixing and Hilbert shards against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievebase.llm import hilbert_shards, mixing, quality_rules

WORD = re.compile("[^\x20\x09-\x0d]+")


def counts_of(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    again = set()
    for i in range(len(words) - 7):
        if seen[tuple(words[i : i + 8])] > 1:
            again.update(range(i, i + 8))
    n_words, repeat = len(words), len(again)
    return (
        n_words, sum(map(len, words)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), repeat,
        n_words < 20 or 100 * repeat > 30 * n_words,
    )


@pytest.mark.parametrize("table", ["dirty", "documents"])
def test_quality_counts(request, table):
    docs = request.getfixturevalue(table)
    got = quality_rules.quality_rules(docs).select("doc_id", *quality_rules.COUNTS, "base_failed", "kept").collect()
    want = Counter((r.doc_id, *counts_of(r.text)) for r in docs.select("doc_id", "text").collect())
    assert Counter(tuple(r)[:-1] for r in got) == want
    assert not any(r.kept for r in got if r.base_failed)


def test_quality_verdict_is_that_of_plain_quantiles(documents):
    rows = quality_rules.with_counts(documents).collect()
    groups, langs, everything = defaultdict(list), defaultdict(list), []
    for r in rows:
        if r.n_words:
            groups[r.lang, r.source].append(r)
            langs[r.lang].append(r)
            everything.append(r)

    def fence(part, rule):
        def bin_(x):
            if x <= 0:
                return 0.0
            b = math.ceil(math.log(x) / math.log(quality_rules.GAMMA))
            return 2 * quality_rules.GAMMA**b / (quality_rules.GAMMA + 1)

        values = sorted(r[rule] for r in part)
        at = lambda q: bin_(values[max(math.ceil(q * len(values)), 1) - 1])
        mid, low = at(0.5), at(0.25)
        return mid, quality_rules.SPREADS * max(mid - low, quality_rules.FLOORS[rule])

    want = set()
    for r in rows:
        if r.base_failed:
            continue
        part = next(p for p in (groups[r.lang, r.source], langs[r.lang], everything) if len(p) >= quality_rules.MIN_DOCS)
        ok = True
        for rule in quality_rules.FLOORS:
            mid, reach = fence(part, rule)
            ok &= r[rule] <= mid + reach and (rule not in quality_rules.TWO_SIDED or r[rule] >= mid - reach)
        if ok:
            want.add(r.doc_id)
    got = {r.doc_id for r in quality_rules.quality_rules(documents).filter("kept").collect()}
    assert len(got ^ want) <= 1  # a value on the edge of a bin may round either way


def test_quality_keeps_labelled_good_documents(spark, sf_dir, documents):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = quality_rules.quality_rules(documents).collect()
    lost = [r for r in rows if labels.get(r.doc_id) == 1 and not r.base_failed and not r.kept]
    junk = [r for r in rows if labels.get(r.doc_id) == 0]
    assert len(lost) <= 1
    assert sum(r.kept for r in junk) <= 0.15 * len(junk)


def test_kept_documents_have_their_own_columns(dirty, empty):
    kept = quality_rules.keep_documents(dirty)
    assert kept.columns == dirty.columns
    assert {tuple(r) for r in kept.collect()} <= {tuple(r) for r in dirty.collect()}
    assert quality_rules.keep_documents(empty).count() == 0
    assert quality_rules.quality_rules(empty).count() == 0


def shares(sizes):
    """Targets by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    total, target, open_ = sum(sizes.values()), {}, set(names)
    left = float(total)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > 3 * sizes[s]]
        if not over:
            return target | {s: level * weight[s] for s in open_}
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            open_.remove(s)
    return target


@pytest.mark.parametrize("table", ["dirty", "documents"])
def test_mix(request, table):
    docs = request.getfixturevalue(table)
    rows = mixing.mix_sources(docs).collect()
    size = Counter((r.doc_id, len(WORD.findall(r.text or ""))) for r in docs.select("doc_id", "text").collect())
    assert Counter((r.doc_id, r["size"]) for r in rows) == size
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    sizes = {s: sum(r["size"] for r in part) for s, part in by.items()}
    goal, largest = shares(sizes), max(r["size"] for r in rows)
    for s, part in by.items():
        assert {r.source_size for r in part} == {sizes[s]}
        assert all(math.isclose(r.target, goal[s], rel_tol=1e-9, abs_tol=1e-6) for r in part)
        assert abs(sum(r.taken for r in part) - goal[s]) <= largest
        assert all(r.taken <= 3 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0) for r in part)
    assert sum(r.taken for r in rows) <= sum(sizes.values())
    again = mixing.mix_sources(docs.repartition(5)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, rows))


@pytest.mark.parametrize("cut_rows", [50_000, 3, 1])
def test_taken_is_that_of_a_plain_fair_queue(documents, monkeypatch, cut_rows):
    """All sends of all queues in order of finish time, one after the other up to the budget, however finely the cut is looked for."""
    monkeypatch.setattr(mixing, "CUT_ROWS", cut_rows)
    rows = mixing.mix_sources(documents).collect()
    place = lambda d: int(hashlib.md5(f"{mixing.SEED}{'' if d is None else d}".encode()).hexdigest()[:15], 16)
    names = sorted({r.source for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    sends, budget = [], sum(r["size"] for r in rows)
    for source in names:
        queue, sent = sorted((r for r in rows if r.source == source), key=lambda r: (place(r.doc_id), r.doc_id)), 0
        for r in queue:
            sent += r["size"]
            if r["size"] and r.target:
                sends += [((t * r.source_size + sent) / r.target, names.index(source), place(r.doc_id), str(r.doc_id), r["size"]) for t in range(mixing.CAP)]
    want, held = Counter(), 0
    for *_, doc, size in sorted(sends):
        held += size
        if held > budget:
            break
        want[doc] += size
    assert {str(r.doc_id): r.taken for r in rows if r.taken} == dict(want)


def test_mixed_documents_repeat_as_taken(documents, empty):
    taken = {r.doc_id: r.taken // r["size"] for r in mixing.mix_sources(documents).collect() if r.taken}
    mixed = mixing.mixed_documents(documents)
    assert mixed.columns == documents.columns
    assert Counter(r.doc_id for r in mixed.select("doc_id").collect()) == Counter(taken)
    assert mixing.mix_sources(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


def test_curve_visits_every_cell_by_single_steps():
    cells = np.stack(np.meshgrid(*[np.arange(4)] * 3, indexing="ij"), -1).reshape(-1, 3)
    order = np.argsort(hilbert_shards.hilbert_index(cells, 2))
    assert sorted(hilbert_shards.hilbert_index(cells, 2)) == list(range(64))
    assert (np.abs(np.diff(cells[order], axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("table", ["dirty", "documents"])
def test_shards(request, table):
    docs = request.getfixturevalue(table)
    rows = hilbert_shards.hilbert_shards(docs).collect()
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        data = (r.text or "").encode()
        want[r.doc_id, len(data) + 16, zlib.crc32(data)] += 1
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots[k]) for k in range(40)]
    assert sum(sizes) == len(rows) and max(sizes) - min(sizes) <= 1
    runs = sorted((r.shard, r.slot, r.curve_index) for r in rows)
    assert [c for _, _, c in runs] == sorted(c for _, _, c in runs)


def test_shards_of_nothing(empty):
    assert hilbert_shards.hilbert_shards(empty).count() == 0


def test_shards_prune(documents):
    """Files cut along the curve have narrower ranges of text size than files cut by a hash."""
    found = hilbert_shards.hilbert_shards(documents).select("doc_id", "size", "shard").toPandas()
    spans = found.groupby("shard")["size"].agg(lambda s: s.max() - s.min()).mean()
    other = found.groupby(found["doc_id"] * 2654435761 % 40)["size"].agg(lambda s: s.max() - s.min()).mean()
    assert spans < other


def test_written_shards(spark, documents, tmp_path):
    shards = hilbert_shards.hilbert_shards(documents, 4)
    hilbert_shards.write_shards(documents, shards, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.groupBy("shard").count().count() == 4 and back.count() == documents.count()


def test_long_names_with_one_beginning_are_told_apart(spark):
    """Whole names decide the level of a row: sources that differ after many bytes get different cells."""
    rows = [(i, "text", "en", f"https://www.example.org/common_crawl_{2000 + i % 8}" if i % 9 else None) for i in range(720)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    ranked = hilbert_shards.ranked(hilbert_shards.described(docs))
    got = {(r._source, r._lang) for r in ranked.select("_source", "_lang").collect()}
    assert got == {(80 * k, 0) for k in range(8)} | {(None, 0)}
    keys = hilbert_shards.curve_keys(ranked).withColumn("cell", F.shiftright("_key", hilbert_shards.HASH_BITS))
    assert keys.filter("doc_id between 360 and 380").select("cell").distinct().count() >= 8
    assert hilbert_shards.hilbert_shards(docs).count() == 720
