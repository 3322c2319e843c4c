"""N-gram join, edit matching, token files, languages and language model against plain Python."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievebase.llm import edit_decontam, lang_mixture, maxent_lm, ngram_join, rans_tokens
from sievebase.llm.common import vocabulary_file

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = {k: k + 32 for k in range(65, 91)}


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


def components_of(rows, width=4, percent=85):
    """Size of each row's set and the least doc_id of its component, by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = words_of(text)
        sets.append(frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset())
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    ids = defaultdict(list)
    for k, (doc, _) in enumerate(rows):
        if doc is not None:
            ids[root(k)].append(doc)
    return Counter((doc, len(sets[k]), min(ids[root(k)]) if ids[root(k)] else None) for k, (doc, _) in enumerate(rows))


def near_copies(seed, n):
    """Groups of copies with random edits, of many sizes, short and long, chained as well."""
    rnd = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    rows = []
    while len(rows) < n:
        base = [rnd.choice(vocab) for _ in range(rnd.choice([3, 6, 9, 12, 25, 60, 150]))]
        text = base
        for _ in range(rnd.choice([1, 1, 2, 5, 25])):
            rows.append((len(rows), " ".join(text)))
            text = list(text if rnd.random() < 0.5 else base)
            for _ in range(rnd.choice([0, 1, 1, 2, 3])):
                at = rnd.randrange(len(text))
                text[at : at + 1] = rnd.choice([[], [rnd.choice(vocab)], [rnd.choice(vocab), text[at]]])
            text = text or ["w"]
    shared = [rnd.choice(vocab) for _ in range(60)]
    for k in range(30):  # documents that share a long passage only
        own = [rnd.choice(vocab) for _ in range(40 + 3 * k)]
        rows.append((len(rows), " ".join(own[:20] + shared + own[20:])))
    return rows


@pytest.mark.parametrize("width, percent, small", [(4, 85, 16), (5, 80, 16), (4, 85, 0), (5, 80, 3)])
def test_join_equals_all_pairs(spark, monkeypatch, width, percent, small):
    monkeypatch.setattr(ngram_join, "SMALL_PART", small)
    rows = near_copies(width, 350)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = ngram_join.jaccard_components(docs, ngram_join.Likeness(width, percent)).collect()
    assert Counter(map(tuple, got)) == components_of(rows, width, percent)


def large_group(seed, n, shape):
    """Near-copies of one text: a star around it, or a chain of copies of copies."""
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(5000)}" for _ in range(120)]
    rows, text = [], base
    for k in range(n):
        rows.append((k, " ".join(text)))
        text = list(base if shape == "star" else text)
        for _ in range(rnd.choice([1, 2, 3, 4, 5, 6, 8]) if shape == "star" else 2):
            text[rnd.randrange(len(text))] = f"x{rnd.randrange(10**6)}"
    return rows


@pytest.mark.parametrize("shape", ["star", "chain"])
def test_join_of_a_large_group(spark, shape):
    rows = large_group(3, 1000, shape)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = Counter(map(tuple, ngram_join.jaccard_components(docs).collect()))
    assert got == components_of(rows)
    assert (len({c for _, _, c in got}) > 1) == (shape == "star")


def test_pairs_of_a_large_group_stay_few(spark, monkeypatch):
    """Sets that do not link with their hub are tested against few others, not against the group."""
    tested = []
    verify = ngram_join.verify
    monkeypatch.setattr(ngram_join, "verify", lambda pairs, corpus: tested.append(pairs.count()) or verify(pairs, corpus))
    docs = spark.createDataFrame(large_group(4, 2000, "star"), "doc_id long, text string").repartition(4)
    ngram_join.jaccard_components(docs).count()
    assert sum(tested) < 4 * 2000


def test_one_doc_id_with_several_texts(spark):
    """Each text links for itself; one row of each component stays, also among rows without an id."""
    rnd = random.Random(8)
    texts = [" ".join(f"w{rnd.randrange(10**6)}" for _ in range(60)) for _ in range(20)]
    rows = [(k, t) for k, t in enumerate(texts)] + [((k + 1) % 20, t + " end") for k, t in enumerate(texts)]
    rows += [(None, texts[0] + " tail"), (None, "own words of a row without any id at all"), (None, "own words of a row without any id at all")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert Counter(map(tuple, ngram_join.jaccard_components(docs).collect())) == components_of(rows)
    kept = ngram_join.one_of_each(docs).collect()
    assert len(kept) == 21 and sum(r.doc_id is None for r in kept) == 1


def test_join_of_dirty_rows(dirty, empty):
    rows = [tuple(r) for r in dirty.select("doc_id", "text").collect()]
    assert Counter(map(tuple, ngram_join.jaccard_components(dirty).collect())) == components_of(rows)
    kept = ngram_join.one_of_each(dirty)
    assert kept.columns == dirty.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(5) == 1 and 6 not in ids and 7 not in ids and None in ids
    assert ngram_join.jaccard_components(empty).count() == 0


def test_both_kinds_of_sets_occur():
    like = ngram_join.Likeness()
    heavy_from = ngram_join.boundary({n: 100 for n in range(1, 600)}, like)
    assert 5 < heavy_from < 600


def test_prefixes_of_alike_sets_meet():
    """Any two alike sets have a key in common, whatever the boundary and the order."""
    like, rnd = ngram_join.Likeness(), np.random.default_rng(5)
    for _ in range(3000):
        n = int(rnd.integers(1, 90))
        a = np.unique(rnd.integers(0, 1 << 63, n).astype(np.uint64))
        b = a[rnd.random(len(a)) > 0.1]
        b = np.unique(np.concatenate([b, rnd.integers(0, 1 << 63, int(rnd.integers(0, 4))).astype(np.uint64)]))
        shared = len(np.intersect1d(a, b))
        if np.array_equal(a, b) or not shared or 100 * shared < 85 * (len(a) + len(b) - shared):
            continue
        sketch = rnd.integers(0, 5, 1 << ngram_join.SKETCH_BITS).astype(np.int32) if rnd.random() < 0.05 else np.zeros(1 << ngram_join.SKETCH_BITS, np.int32)
        heavy_from = int(rnd.integers(1, 100))
        keys = [set(ngram_join.prefix_keys(x, sketch, heavy_from, like).tolist()) for x in (a, b)]
        assert keys[0] & keys[1]


# --- edit matching ----------------------------------------------------------------------------


def least_edits(item, text):
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, d in enumerate(item, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (c != d)))
        row = new
        best = min(best, row[-1])
    return best


def test_matching_equals_plain_edit_distance():
    rnd = random.Random(2)
    for _ in range(400):
        items = [(i, "".join(rnd.choice("abcde ") for _ in range(rnd.randint(3, 50))).strip() or "a") for i in range(4)]
        part = list(items[0][1])
        for _ in range(rnd.randint(0, 4)):
            at = rnd.randrange(len(part) + 1)
            part[at : at + 1] = rnd.choice([[], ["a"], ["b", "c"]])
        text = "".join(rnd.choice("abcde ") for _ in range(40)) + "".join(part) + "".join(rnd.choice("abcde ") for _ in range(40))
        rate = rnd.choice([0.05, 0.1, 0.2])
        want = {i: d for i, x in items if (d := least_edits(x, text)) <= edit_decontam.budget(x, rate)}
        assert {i: d for i, d, _, _ in edit_decontam.Matcher(items, rate).find(text)} == want


def test_planted_items_are_found_and_clean_documents_are_not(spark, sf_dir, documents):
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    norm = lambda t: re.sub(r"[\W_]+", " ", t.lower()).strip()
    items = {r.item_id: norm(r.text) for r in benchmark.collect()}
    exact = {(d.doc_id, i) for d in documents.collect() for i, x in items.items() if x in norm(d.text)}
    got = edit_decontam.find_leaks(documents, benchmark)
    assert {(r.doc_id, r.item_id) for r in got.filter("distance = 0").collect()} == exact and exact
    rnd = random.Random(4)
    edited = []
    for k, text in enumerate(items.values()):
        chars = list(text)
        for _ in range(edit_decontam.budget(text, edit_decontam.ERROR_RATE)):
            chars[rnd.randrange(len(chars))] = rnd.choice("xyz")
        edited.append((k, "Some words before, " + "".join(c.upper() if c.isascii() else c for c in chars) + "! And after."))
    found = edit_decontam.find_leaks(spark.createDataFrame(edited, "doc_id long, text string"), benchmark)
    assert {r.doc_id for r in found.collect()} == set(range(len(items)))
    leaking = {r.doc_id for r in got.collect()}
    clean = edit_decontam.clean_documents(documents, benchmark)
    assert clean.columns == documents.columns
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in documents.collect()} - leaking


def test_matching_of_dirty_rows(spark, dirty, empty):
    benchmark = spark.createDataFrame([(1, "LAZY dog, while seven"), (2, None), (3, " .. "), (4, "lazy dog while seven"), (None, "zzz")], "item_id long, text string")
    got = edit_decontam.find_leaks(dirty, benchmark)
    assert Counter((r.doc_id, r.item_id) for r in got.collect()) == Counter((d, i) for d in (5, 5, 6, 7, 8) for i in (1, 4))
    assert edit_decontam.find_leaks(empty, benchmark).count() == 0
    assert edit_decontam.find_leaks(dirty, benchmark.limit(0)).count() == 0
    clean = edit_decontam.clean_documents(dirty, benchmark)
    assert clean.columns == dirty.columns and clean.count() == dirty.count() - 5


def test_blocks_of_items_change_nothing(spark, sf_dir, documents, monkeypatch):
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    whole = Counter(map(tuple, edit_decontam.find_leaks(documents, benchmark).collect()))
    monkeypatch.setattr(edit_decontam, "BLOCK_CHARS", 3000)
    assert len(list(edit_decontam.item_blocks(benchmark))) > 1
    assert Counter(map(tuple, edit_decontam.find_leaks(documents, benchmark).collect())) == whole


# --- token files ------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_file())
    return t


def test_pieces_give_the_ids_of_whole_texts(tokenizer):
    rnd = random.Random(3)
    signs = ["a", "b", "s", "t", "re", "ll", "'", "'s", "'t", " ", "  ", "\n", "\t", "1", "é", "ñ", ".", "—", "日", "\x1c", "\x85", "²", "😀", "'LL"]
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 30))) for _ in range(4000)] + ["", "<|endoftext|> x"]
    data = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])])
    ids, sizes = rans_tokens.Encoder(vocabulary_file()).encode(np.frombuffer(b"".join(data), np.uint8), offsets)
    ends = np.cumsum(sizes)
    for end, size, whole in zip(ends, sizes, tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert ids[end - size : end].tolist() == [*whole.ids, 2]


@pytest.mark.parametrize("n, kinds", [(1, 1), (31, 3), (70_000, 1), (200_001, 5000), (150_000, 50_000)])
def test_coder_round_trip(n, kinds):
    rnd = np.random.default_rng(n)
    ids = np.minimum(rnd.zipf(1.3, n), kinds).astype(np.uint16)
    row = rans_tokens._segment(1, ids, [1], np.array([n]))
    tables = np.frombuffer(row["symbols"], "<u2"), np.frombuffer(row["frequencies"], "<u4")
    assert int(tables[1].sum()) == 1 << rans_tokens.SCALE_BITS
    assert (rans_tokens.decode_blocks(row["blocks"], *tables) == ids).all()
    for block in row["blocks"]:  # blocks are independent
        assert (rans_tokens.decode_blocks([block], *tables) == ids[block["first"] : block["first"] + block["n"]]).all()
    damaged = dict(row["blocks"][0], states=b"\0" * 8 + row["blocks"][0]["states"][8:])
    with pytest.raises(ValueError):
        rans_tokens.decode_blocks([damaged], *tables)


@pytest.mark.parametrize("table", ["dirty", "documents"])
def test_token_files(request, tokenizer, table):
    docs = request.getfixturevalue(table)
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or "") for r in docs.select("doc_id", "text").collect()))
    want, start = [], 0
    for known, doc, _, text in rows:
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        want.append((doc if known else None, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [tuple(r) for r in rans_tokens.token_files(docs, vocabulary_file()).orderBy("start").collect()]
    assert got == want


def test_added_tokens_have_their_own_ids(spark, tokenizer):
    mark = "<|endoftext|>"
    texts = [f"a {mark} b", mark, mark * 3, f"  {mark}  ", f"it's{mark}'s", f"x\n\n{mark}\ny", "<|endoftext|", "|>", mark[:5], f"{mark[5:]} {mark}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1)
    got = [tuple(r)[2:] for r in rans_tokens.token_files(docs, vocabulary_file()).orderBy("doc_id").collect()]
    want = [[*tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    assert 50256 in want[0] and got == [(len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for ids in want]


def test_a_small_store_gives_the_same_ids(monkeypatch):
    rnd = random.Random(5)
    texts = [" ".join(f"w{rnd.randrange(3000)}\n" if rnd.random() < 0.1 else f"{rnd.randrange(900)}é" for _ in range(200)) for _ in range(60)]
    data = [t.encode() for t in texts]
    offsets, whole = np.concatenate([[0], np.cumsum([len(d) for d in data])]), np.frombuffer(b"".join(data), np.uint8)
    want = rans_tokens.Encoder(vocabulary_file()).encode(whole, offsets)
    monkeypatch.setattr(rans_tokens, "PART_PIECES", 300)
    monkeypatch.setattr(rans_tokens, "CACHE_PIECES", 700)
    monkeypatch.setattr(rans_tokens, "SLOT_BITS", 10)
    monkeypatch.setattr(rans_tokens, "JOINED", 7)
    got = rans_tokens.Encoder(vocabulary_file()).encode(whole, offsets)
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def test_rows_without_an_id_are_spread(spark):
    docs = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text")).repartition(4)
    got = rans_tokens.token_files(docs, vocabulary_file())
    rows = got.orderBy("start").collect()
    assert [r.start for r in rows] == list(np.cumsum([0, *[r.n_tokens for r in rows[:-1]]]))
    assert len(rows) == 4000


def test_token_files_of_nothing(empty):
    assert rans_tokens.token_files(empty, vocabulary_file()).count() == 0


# --- languages --------------------------------------------------------------------------------


def test_languages_of_held_out_documents(documents):
    out = lang_mixture.held_out(F.col("doc_id"), 5)
    langs, tables = lang_mixture.learn(documents.filter(~out))
    assert langs == ["de", "en", "es", "fr"]
    rows = lang_mixture.identify(documents, langs, tables).join(documents.select("doc_id", "lang", out.alias("out")), "doc_id").filter("out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.97 * len(rows)


def test_mixture_is_found(spark, documents):
    langs, tables = lang_mixture.learn(documents)
    part = {}
    for r in documents.select("lang", "text").collect():
        part.setdefault(r.lang, " ".join(r.text.split()[:80]))
    mixed = spark.createDataFrame([(1, part["en"] + " " + part["de"]), (2, part["fr"])], "doc_id long, text string")
    found = {r.doc_id: r for r in lang_mixture.identify(mixed, langs, tables).collect()}
    assert set(found[1].langs) == {"en", "de"} and all(0.3 < s < 0.7 for s in found[1].shares)
    assert found[2].langs == ["fr"] and found[2].lang_pred == "fr"


def test_expectation_maximisation_equals_a_plain_one():
    rnd = np.random.default_rng(1)
    like = rnd.random((50, 3))
    shares, total = lang_mixture.proportions(like, np.array([0, 20, 50]), np.full((2, 3), 1 / 3), 12)
    for k, part in enumerate((like[:20], like[20:])):
        own = np.full(3, 1 / 3)
        for _ in range(12):
            joint = part * own
            own = (joint / joint.sum(1, keepdims=True)).mean(0)
        assert np.allclose(own, shares[k], atol=1e-5)
        assert math.isclose(np.log((part * own).sum(1)).sum(), total[k], rel_tol=1e-4)


def test_sets_do_not_depend_on_neighbours(documents):
    """Two equal languages share a text's larger part, so two are worse than one and three are better; alone as beside others."""
    _, tables = lang_mixture.learn(documents.filter("lang in ('de', 'en')"))
    tables = tables[[1, 1, 0]]
    part = {r.lang: r.text.split() for r in documents.filter("lang in ('de', 'en')").dropDuplicates(["lang"]).select("lang", "text").collect()}
    texts = [" ".join(part["en"][:80] + part["de"][:20]), " ".join(part["en"][:50] + part["de"][:50])]

    def chosen(found):
        data = [t.encode() for t in found]
        return lang_mixture.infer(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]), tables)[1]

    alone, beside = chosen(texts[:1])[0], chosen(texts)[0]
    assert (alone > 0).all() and 0.1 < alone[2] < 0.3
    assert np.allclose(alone, beside)


def test_languages_of_dirty_rows(dirty, empty):
    langs, tables = lang_mixture.learn(dirty)
    rows = lang_mixture.identify(dirty, langs, tables).collect()
    assert len(rows) == dirty.count() and all(0 <= r.score <= 1 for r in rows)
    unknown = {r.doc_id for r in rows if r.lang_pred == "und"}
    assert unknown == {0, 1, 2, 12}
    none, nothing = lang_mixture.learn(empty)
    assert none == [] and {r.lang_pred for r in lang_mixture.identify(dirty, none, nothing).collect()} == {"und"}
    assert lang_mixture.identify(empty, langs, tables).count() == 0


# --- language model ---------------------------------------------------------------------------


@pytest.mark.parametrize("table, common", [("dirty", 1 << 20), ("documents", 1 << 20), ("documents", 50)])
def test_base_scores_and_counts(request, monkeypatch, table, common):
    monkeypatch.setattr(maxent_lm, "COMMON", common)
    docs = request.getfixturevalue(table)
    got = maxent_lm.score(docs, lang_mixture.held_out(F.col("doc_id"), 10)).collect()
    tokens = [(r.doc_id, [*words_of(r.text), None]) for r in docs.select("doc_id", "text").collect()]
    out = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
    count = Counter(t for d, ts in tokens if not out(d) for t in ts)
    total, kinds = sum(count.values()), len(count)
    want = Counter(
        (d, out(d), len(ts), sum(count[t] > 0 for t in ts), total, round(sum(math.log10((count[t] + 0.1) / (total + 0.1 * (kinds + 1))) for t in ts), 3))
        for d, ts in tokens
    )
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 3)) for r in got) == want
    if table == "documents":
        held = [r for r in got if r.held_out]
        assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_model_is_a_distribution(documents):
    """Class probabilities add up to one, and so do the tokens of each class with one place for unknown words."""
    train = documents.limit(50)
    counts = maxent_lm.count_words(train)
    model = maxent_lm.learn_weights(train, counts)
    rows = np.random.default_rng(0).integers(0, len(model.weights), (40, maxent_lm.TEMPLATES))
    assert np.allclose(np.exp(maxent_lm.class_log_probs(model.weights, model.bias, rows)).sum(1), 1, atol=1e-4)
    table = counts.table.toPandas()
    for k, part in table.groupby("class"):
        room = counts.tokens[k] + maxent_lm.SMOOTHING * (counts.kinds[k] + 1)
        assert math.isclose((part["c"] + maxent_lm.SMOOTHING).sum() + maxent_lm.SMOOTHING, room)


def test_scores_do_not_depend_on_partitions(documents):
    """The same model from 1 and from 13 partitions, up to the rounding of sums."""
    out = lang_mixture.held_out(F.col("doc_id"), 10)
    one, many = ({r.doc_id: r.score for r in maxent_lm.score(documents.repartition(n), out).collect()} for n in (1, 13))
    assert all(math.isclose(one[k], many[k], rel_tol=1e-5) for k in one)


def test_scores_equal_a_plain_model(spark):
    """Every step in plain Python on a few texts: counts of features and classes, expected counts, the scaled weights."""
    rnd = random.Random(2)
    words = ["red", "blued", "greened", "sing", "ring", "Tall", "x"]
    texts = [" ".join(rnd.choice(words[k % 3 :]) for _ in range(rnd.randrange(1, 30))) for k in range(24)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    out = lambda d: zlib.crc32(str(d).encode()) % 10 == 0
    got = {r.doc_id: r.score for r in maxent_lm.score(docs, lang_mixture.held_out(F.col("doc_id"), 10)).collect()}
    bits = maxent_lm.row_bits(len(words) + 1)
    made = {}
    for k, t in enumerate(texts):
        data = np.frombuffer(t.encode(), np.uint8)
        tokens = maxent_lm.tokens_of(data, np.array([0, len(data)]))
        made[k] = maxent_lm.context_rows(tokens, bits).tolist(), tokens.classes.tolist(), tokens.words.tolist()
    train = [m for k, m in made.items() if not out(k)]
    n, kinds = Counter(c for m in train for c in m[1]), defaultdict(set)
    count = Counter(w for m in train for w in m[2])
    for m in train:
        for c, w in zip(m[1], m[2]):
            kinds[c].add(w)
    total = sum(n.values()) + maxent_lm.SMOOTHING * maxent_lm.CLASSES
    share = [(n[c] + maxent_lm.SMOOTHING) / total for c in range(maxent_lm.CLASSES)]
    seen, met = Counter(), Counter()
    for rows, classes, _ in train:
        for features, c in zip(rows, classes):
            for f in features:
                seen[f, c] += 1
                met[f] += 1
    weight = defaultdict(float)
    more = lambda c: maxent_lm.CAUTION * share[c]

    def chances(features):
        z = [math.log(share[c]) + sum(weight[f, c] for f in features) for c in range(maxent_lm.CLASSES)]
        return [math.exp(x) / sum(map(math.exp, z)) for x in z]

    for f in met:
        for c in range(maxent_lm.CLASSES):
            weight[f, c] = maxent_lm.FIRST_RATE * math.log((seen[f, c] + more(c)) / (met[f] * share[c] + more(c)))
    for _ in range(maxent_lm.ROUNDS):
        expected = defaultdict(float)
        for rows, _, _ in train:
            for features in rows:
                for c, p in enumerate(chances(features)):
                    for f in features:
                        expected[f, c] += p
        for f in met:
            for c in range(maxent_lm.CLASSES):
                weight[f, c] += maxent_lm.RATE * math.log((seen[f, c] + more(c)) / (expected[f, c] + more(c)))
    for k, (rows, classes, tokens) in made.items():
        want = 0.0
        for features, c, w in zip(rows, classes, tokens):
            room = n[c] + maxent_lm.SMOOTHING * (len(kinds[c]) + 1)
            want += math.log10(chances(features)[c]) + math.log10((count[w] + maxent_lm.SMOOTHING) / room)
        assert math.isclose(got[k], want, rel_tol=1e-4), k


def test_rows_grow_with_the_vocabulary():
    bits = [maxent_lm.row_bits(n) for n in (0, 10_000, 30_000, 60_000, 10**9)]
    assert bits == sorted(bits) and bits[0] == maxent_lm.LEAST_ROW_BITS and bits[-1] == maxent_lm.MOST_ROW_BITS and len(set(bits)) == 4


def test_scores_of_nothing(empty):
    assert maxent_lm.score(empty, lang_mixture.held_out(F.col("doc_id"), 10)).count() == 0


def test_a_second_round_of_the_model_moves_its_expectations_to_what_was_seen(spark):
    texts = ["the red cat sat on the mat", "a red dog ran to the cats", "the dog sat", "ran red"] * 12
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert maxent_lm.ROUNDS >= 2
    counts = maxent_lm.count_words(docs)
    data = " ".join(texts).encode()
    tokens = maxent_lm.tokens_of(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    bits = maxent_lm.row_bits(counts.kinds.sum())
    rows = maxent_lm.context_rows(tokens, bits)
    model = maxent_lm.learn_weights(docs, counts)
    own = maxent_lm.own_log_probs(model.weights, model.bias, rows, tokens.classes)
    logs = maxent_lm.class_log_probs(model.weights, model.bias, rows)
    assert np.allclose(own, logs[np.arange(len(logs)), tokens.classes], atol=1e-5)
    plain, sums = np.zeros_like(model.weights), np.zeros_like(model.weights)
    for chances, places in zip(np.exp(logs), rows):
        for k in places:
            plain[k] += chances
    maxent_lm.add_expected(sums, model.weights, model.bias, rows)
    assert np.allclose(plain, sums, rtol=1e-3, atol=1e-4)
