"""Merkle manifest, main text of pages and fill-in-the-middle against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from html import unescape

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sievebase.llm import fill_middle, html_main, merkle_manifest, statements
from tools.compare import compare, duck


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(statements.llm_statements()))
def test_query_equals_its_statement(spark, sf_dir, name):
    ok, info = compare(spark, duck(sf_dir), entry.queries()[name], statements.llm_statements()[name], sf_dir)
    assert ok, info


# --- manifest ---------------------------------------------------------------------------------


def leaf_of(row, more=0):
    values = (row.doc_id, row.source, row.lang, None if row.n_chars is None else row.n_chars + more, row.text)
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels_of(row):
    out = [row]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][k : k + 2])) for k in range(0, len(out[-1]), 2)])
    return out


def siblings(tree, k):
    for row in tree[:-1]:
        yield (k % 2, row[k ^ 1]) if k ^ 1 < len(row) else None
        k //= 2


def manifest_of(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[row.lang].append((row.doc_id is not None, row.doc_id or 0, leaf_of(row), row))
    order = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    trees = {k: levels_of([x[2] for x in sorted(groups[k], key=lambda x: x[:3])]) for k in order}
    top = levels_of([trees[k][-1][0] for k in order])
    for at, lang in enumerate(order):
        for k, (_, _, leaf, row) in enumerate(sorted(groups[lang], key=lambda x: x[:3])):
            path = [*siblings(trees[lang], k), *siblings(top, at)]
            tampered = None not in (row.n_chars, row.doc_id) and zlib.crc32(str(row.doc_id).encode()) % 7 == 0
            end = leaf_of(row, 1) if tampered else leaf
            for step in path:
                end = sha(end) if step is None else sha(step[1] + end) if step[0] else sha(end + step[1])
            yield row.doc_id, leaf, trees[lang][-1][0], top[-1][0], sha("".join(s[1] for s in path if s)), end, end == top[-1][0]


@pytest.mark.parametrize("span", [1, 3, 8])
@pytest.mark.parametrize("table", ["dirty", "documents"])
def test_manifest_equals_a_plain_tree(request, monkeypatch, table, span):
    monkeypatch.setattr(merkle_manifest, "SPAN", span)
    docs = request.getfixturevalue(table)
    got = merkle_manifest.verified_rows(merkle_manifest.dataset_manifest(docs)).drop("rank")
    assert Counter(map(tuple, got.collect())) == Counter(manifest_of(docs.collect()))


def test_nodes_cover_their_leaves(documents):
    made = merkle_manifest.dataset_manifest(documents)
    nodes = made.nodes.filter("tier = 0").collect()
    leaves = {(f"={r.lang}" if r.lang is not None else "", r["rank"]): r.leaf for r in made.leaves.collect()}
    by_place = {(n.grp, n.level, n.lo): n for n in nodes}
    assert len(by_place) == len(nodes)
    for n in nodes:
        if n.level == 0:
            assert leaves[n.grp, n.lo] == n.digest and n.hi == n.lo + 1
        else:
            parts = [by_place.get((n.grp, n.level - 1, lo)) for lo in (n.lo, n.lo + (1 << n.level - 1))]
            assert n.digest.hex() == sha("".join(p.digest.hex() for p in parts if p)) and n.hi == max(p.hi for p in parts if p)


def test_manifest_of_little(spark, empty, dirty):
    assert merkle_manifest.verified_rows(merkle_manifest.dataset_manifest(empty)).count() == 0
    one = merkle_manifest.verified_rows(merkle_manifest.dataset_manifest(dirty.filter("doc_id = 3"))).first()
    assert one.leaf == one.subroot == one.root and one.proof_sha256 == sha("")


def test_ranks_of_equal_rows(spark):
    rows = spark.range(1000).select(F.lit("g").alias("grp"), F.lit(7).alias("doc_id")).repartition(5)
    got = merkle_manifest.ranked(rows, ["doc_id"]).collect()
    assert sorted(r["rank"] for r in got) == list(range(1000)) and {r.n for r in got} == {1000}


# --- pages ------------------------------------------------------------------------------------


def test_articles_of_the_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r.text for r in html_main.extract(pages).collect()}
    for row in pages.collect():
        article = re.search("<article>(.*?)</article>", row.html, re.S)[1]
        blocks = (" ".join(unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("<p>|</p>|</h1>", article))
        assert got[row.page_id] == "\n".join(b for b in blocks if b)


PAGE = """<html><head><title>T</title></head><body class="with-sidebar">
<div><a href="/">Home</a> <a href="/news">News of the day</a></div>
<div>All the news that is fit to read on this screen every day</div>
<h1>{title}</h1><p>{text}</p>
<div>Sign up now and never miss a single story from our desk</div>
<aside>Also read</aside><div id="comments"><p>First!</p></div><!-- <p>no</p> --><script>var a = "<p>no</p>";</script></body></html>"""


def test_what_a_host_repeats_goes(spark):
    """Without an article element, only other pages of the host tell what is not text."""
    own = [" ".join(f"word{k}x{i}" for i in range(20)) for k in range(6)]
    rows = [(k, "https://news.example.org/a", PAGE.format(title=f"Title number {k} of six", text=t)) for k, t in enumerate(own)]
    rows += [(10, "https://other.example.org/a", PAGE.format(title="Alone", text=own[0])), (11, "https://other.example.org/b", PAGE.format(title="Alone", text=own[0]))]
    got = {r.page_id: r for r in html_main.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    for k, t in enumerate(own):
        assert got[k].text == f"Title number {k} of six\n{t}"
    # Equal pages are no evidence of each other.
    assert "All the news" in got[10].text and own[0] in got[11].text


def test_the_array_reads_articles(spark):
    """A passage that articles of a host share is counted as repeated, and stays in their texts."""
    passage = " ".join(f"shared{i}" for i in range(12))
    page = "<nav>Home {k}</nav><article><h1>Own title {k}</h1><p>{p}</p><p>Only this page {k} says these words {k} of all {k}</p></article>"
    rows = [(k, f"https://h{k // 2}.example/a", page.format(k=k, p=passage if k < 3 else f"other{k} " * 12)) for k in range(4)]
    rows.append((4, "https://h0.example/a", rows[0][2]))
    got = {r.page_id: r for r in html_main.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    # Page 2 is of another host than 0 and 1; page 4 is page 0 again.
    assert {k: r.n_repeated for k, r in got.items()} == {0: 1, 1: 1, 2: 0, 3: 0, 4: 1}
    assert all(got[k].text == f"Own title {k}\n{passage}\nOnly this page {k} says these words {k} of all {k}" and got[k].n_blocks == 4 for k in range(3))


def test_keys_of_many_streams():
    rnd = np.random.default_rng(5)
    streams = [rnd.integers(0, 1 << 60, n).astype(np.uint64) for n in (1, 3, 7, 8, 9, 30, 1)]
    hosts = np.arange(7, dtype=np.uint64)
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in streams])])
    row, at, keys = html_main.suffix_keys(np.concatenate(streams), bounds, hosts)
    for k, stream in enumerate(streams):
        want = html_main.mix(html_main.prefix_keys(stream) + hosts[k])
        assert keys[row == k].tolist() == want.tolist() and at[row == k].tolist() == list(range(len(want)))


@pytest.mark.parametrize("html, text", [
    (None, ""), ("", ""), ("plain  text &lt;b&gt; &amp", "plain text <b> &"), ("<p>one<br>two<p>three", "one two\nthree"),
    ("<article><header><h1>T</h1><span>by x</span></header><p>a &nbsp; b</p><footer>f</footer><p>c</p></article><p>out</p>", "T\na b\nc"),
    ("<main><p>in</p><form>q <p>r</p></form></main><p>out", "in"), ("<article><p>a<!-- b --><i>c</i> < d</p><script>x", "ac < d"),
    ("<div class='content'><p>yes</p><div class=\"ad box\">no</div></div><div>else</div>", "yes"), ("<style>a</style><p title='>'>b</p>", "b"),
    ("<article><ul><li>a<li>b</ul><div id=comments><article>c</article></div>d</article>", "a\nb\nd"), ("<p>a</p><!-- open <p>b", "a"),
    ("<article><p class=cookie-notice>no<p>yes</article>", "yes"), ("<div class='layout with-sidebar'>text</div>", "text"),
])
def test_marks_of_a_page(spark, html, text):
    found = html_main.candidates(html_main.blocks_of(html or ""))
    assert "\n".join(c.text for c in found) == text


def test_repeated_runs_equal_a_plain_search(spark):
    """Blocks of random token streams: covered where RUN tokens stand on another page of the host."""
    rnd = random.Random(4)
    pages, streams = [], {}
    phrases = [[f"w{rnd.randrange(40)}" for _ in range(rnd.choice([3, 9, 14]))] for _ in range(12)]
    for k in range(40):
        blocks = [rnd.choice(phrases) if rnd.random() < 0.5 else [f"u{rnd.randrange(10**6)}" for _ in range(10)] for _ in range(rnd.randrange(1, 6))]
        pages.append((k, f"http://h{k % 3}.example/", "".join(f"<p>{' '.join(b)}</p>" for b in blocks)))
        streams[k] = (k % 3, [t for b in blocks for t in [".", *b]], blocks)

    def windows(tokens):
        n = min(html_main.RUN, len(tokens))
        return [tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1)]

    seen = defaultdict(set)
    for k, (host, tokens, _) in streams.items():
        for w in windows(tokens):
            seen[host, w].add(tuple(tokens))
    docs = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    for row in html_main.extract(docs).collect():
        host, tokens, blocks = streams[row.page_id]
        same = {k for k, x in streams.items() if x[0] == host}
        covered = np.zeros(len(tokens), bool)
        for i, w in enumerate(windows(tokens)):
            if len({pages[k][2] for k in same if w in set(windows(streams[k][1]))}) > 1:
                covered[i : i + len(w)] = True
        want, at = [], 0
        for b in blocks:
            if 2 * covered[at : at + len(b) + 1].sum() <= len(b) + 1:
                want.append(" ".join(b))
            at += len(b) + 1
        assert row.text == "\n".join(want)


def test_pages_of_dirty_rows(spark):
    long = "<p>" + "wort & mehr " * 100_000 + "</p>"
    rows = [(None, None, None, "x"), (1, "not an address", "<p>a", "y"), (1, "not an address", "<p>a", "y"), (2, "http://h/", long, None), (3, "HTTP://H/x", "<" * 10_000, None)]
    got = html_main.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    found = {r.page_id: r for r in got}
    assert len(got) == 5 and found[None].text == "" and found[1].text == "a" and found[3].text == "<" * 10_000
    assert found[2].text == ("wort & mehr " * 100_000).strip() == found[2].text and found[2].n_chars == len(found[2].text)
    assert html_main.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# --- fill-in-the-middle -----------------------------------------------------------------------

UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def fim_of(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    found = sha(f"42:{'' if doc_id is None else doc_id}")
    h = [int(found[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    plain = not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50
    form = "plain" if plain else "spm" if h[3] % 100 < 80 else "psm"
    out = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
    return out, (doc_id, len(units), form, None if plain else len(p), None if plain else len(m), sha(out), sha(text))


@pytest.mark.parametrize("table", ["dirty", "documents"])
def test_fim_equals_plain_strings(request, table):
    docs = request.getfixturevalue(table)
    want = [fim_of(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert Counter(map(tuple, fill_middle.fim_digests(docs).collect())) == Counter(x for _, x in want)
    texts = fill_middle.fim_texts(docs)
    assert texts.columns == [*docs.columns, "fim_form"]
    assert Counter(r.text for r in texts.collect()) == Counter(t for t, _ in want)


def test_fim_of_marks_and_spaces(spark):
    texts = ["a <P> b", "<S>", " lead and tail \n", "\t\n ", "x", "<P <M <S a < P>", "né 日本 😀 ñ " * 3]
    rows = [(k, t) for t in texts for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, fill_middle.fim_digests(docs).collect())) == Counter(fim_of(*r)[1] for r in rows)


def test_fim_of_nothing(empty):
    assert fill_middle.fim_digests(empty).count() == 0 and fill_middle.fim_texts(empty).count() == 0


def test_cutting_splits_one_descriptor():
    piece = fill_middle.Piece
    table = [piece(0, 0, 5), piece(1, 3, 6), piece(0, 9, 12)]
    for at in range(12):
        left, right = fill_middle.cut(table, at)
        assert sum(p.end - p.start for p in left) == at and len(left) + len(right) <= 4
        buffers = (memoryview(bytes(range(20))), memoryview(bytes(range(100, 120))))
        assert b"".join(fill_middle.stream(left + right, buffers)) == b"".join(fill_middle.stream(table, buffers))


def test_restoring_is_the_inverse():
    rnd = random.Random(3)
    for _ in range(500):
        parts = ["".join(rnd.choice("<PSM> a>") for _ in range(rnd.randrange(6))) for _ in range(3)]
        if any(m in x for x in (*parts, "".join(parts)) for m in ("<P>", "<S>", "<M>")):
            continue
        p, m, s = parts
        for form, out in (("psm", f"<P>{p}<S>{s}<M>{m}"), ("spm", f"<S>{s}<P>{p}<M>{m}")):
            buffers = (memoryview(out.encode()), memoryview(fill_middle.MARK_BUFFER))
            assert b"".join(fill_middle.stream(fill_middle.restored(out.encode(), form), buffers)).decode() == p + m + s
