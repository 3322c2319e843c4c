"""N-gram Jaccard join: documents whose sets of word shingles are alike, exactly.

Method: a size-aware heavy-light join. Shingles have one global order, rare ones
first. Two sets of at least the wanted likeness share the two first of their
common shingles within short prefixes of both. A *light* (small) set enumerates all
two-element subsets of its prefix, and two light sets meet on an equal subset; a
*heavy* (large) set has too many, so it scans the inverted lists of its prefix's
shingles, which also hold the light sets large enough to be its partners. The
boundary is the size with the least estimated cost over the sizes that occur.

Exact copies (equal sets) are one node from the start. Within a list, pairs are not
enumerated. First every set is tested against the most central set of its lists, which
joins most copies and near-copies into components. Lists that still hold several
components are cut by size, as alike sets have like sizes. In parts of at most
SMALL_PART sets pairs meet directly, a bounded number for each set. In larger parts all
sets are described by what they lack of the part's hub and what they have beyond it. Two sets of which one does not link with the hub can only link if these
*deltas* have a number of shingles in common that their sizes give, at least one; so
they meet on the prefixes of their deltas, rare shingles first, and where the places of
the common one leave room for that number. In a group of near-copies the deltas are
small and mostly each copy's own, and work grows with the group and not its square.
Every link is verified on the whole sets, and none is lost: pairs of sets of one part
are either both linked with its hub, or one of them meets the other by its delta.

The order comes from a count sketch of fixed size over all shingles; any order
gives the same links. Filters of bounded size thin rows before exact joins.

Shingles and sets are 64-bit hashes; a set of equal hash and size is equal.

Defined cases: a text without words, or null, has an empty set and links with
nothing, also not with another empty one; with fewer than ``width`` words the
whole sequence is its one shingle; a null doc_id is nobody's component_id unless
no other is there; repeated rows are copies; one doc_id with several texts is several
documents, which its doc_id does not link; empty tables give empty results; other
columns are ignored by the join and kept by ``one_of_each``, which takes rows with
equal doc_id and text, whatever else differs, as repeated rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb, log
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievebase.llm.common import (
    ARRAY_SCHEMA, array_rows, chunks, fill, key_filter, materialize, may_hold, mix, sum_arrays, word_hashes,
)

SKETCH_BITS = 20
LIST_WEIGHT = 4.0  # what an entry of an inverted list costs, in subset keys
LARGEST_LIGHT = 1000
SALTS = 32
SMALL_PART = 16


class Likeness(NamedTuple):
    """Words of a shingle, and the least Jaccard likeness in percent."""

    width: int = 4
    percent: int = 85

    def overlap(self, n: int) -> int:
        """Shingles that a set of size n shares at least with any partner."""
        return -(-self.percent * n // 100)


# --- sets -------------------------------------------------------------------------------------


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, before = word_hashes(data, offsets)
    keys = [mix(np.array([k + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1) for k in range(width)]
    n = max(0, len(words) - width + 1)
    windows = np.zeros(n, np.uint64)
    for k in range(width):
        windows += words[k : k + n] * keys[k]
    windows = mix(windows)
    for a, b in zip(before[:-1].tolist(), before[1:].tolist()):
        if b - a >= width:
            yield np.unique(windows[a : b - width + 1])
        elif b > a:
            whole = sum((words[a + k : a + k + 1] * keys[k] for k in range(b - a)), np.array([b - a], np.uint64))
            yield mix(whole ^ np.uint64(0x5851F42D4C957F2D))
        else:
            yield windows[:0]


def set_hash(values: np.ndarray) -> int:
    """A signed 64-bit hash of a set."""
    with np.errstate(over="ignore"):
        total = np.array([mix(values ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64) + np.uint64(len(values))], np.uint64)
    return int(mix(total).view(np.int64)[0])


def _buckets(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def describe(docs: DataFrame, like: Likeness) -> tuple[DataFrame, np.ndarray]:
    """One pass: (doc_id, loc, n, node) per document, and the count sketch of all shingles. ``loc`` finds the row again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        names = [f.strip().split(" ")[0] for f in schema.split(",")]
        for rows, data, offsets in chunks(batches):
            sets = list(shingle_sets(data, offsets, like.width))
            counts += np.bincount(_buckets(np.concatenate(sets)), minlength=len(counts))
            sizes, nodes = pa.array([len(s) for s in sets], pa.int64()), pa.array([set_hash(s) for s in sets], pa.int64())
            none = [pa.nulls(len(sets), t) for t in (pa.string(), pa.int32(), pa.binary())]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), sizes, nodes, *none], names=names)
        parts = list(array_rows("sketch", counts.astype(np.int32)))
        if parts:
            none = [pa.nulls(len(parts), pa.int64())] * 4
            key, block, cells = zip(*parts)
            yield pa.RecordBatch.from_arrays([*none, pa.array(key), pa.array(block, pa.int32()), pa.array(cells, pa.binary())], names=names)

    schema = f"doc_id long, loc long, n long, node long, {ARRAY_SCHEMA}"
    found = materialize(located(docs).mapInArrow(run, schema), "sets")
    sketch = sum_arrays(found.filter("key is not null").select("key", "block", "cells"), "int32").get("sketch")
    return found.filter("key is null").select("doc_id", "loc", "n", "node"), fill(sketch, 1 << SKETCH_BITS, "int32")


def located(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), place().alias("loc"), "text")


def place() -> Column:
    """What tells documents apart: repeated rows have one place."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))


# --- candidate lists --------------------------------------------------------------------------


def boundary(sizes: dict[int, int], like: Likeness) -> int:
    """The least size that is heavy, by estimated cost: subset keys of light sets, list entries of heavy ones and their possible partners."""
    prefix = {n: n - like.overlap(n) + 1 for n in sizes}
    light = {n: c * comb(prefix[n] + 1, 2) for n, c in sizes.items()}
    heavy = {n: c * prefix[n] * LIST_WEIGHT for n, c in sizes.items()}
    best, least = 1, float("inf")
    for x in range(1, LARGEST_LIGHT + 1):
        partner = like.overlap(x)
        cost = sum(light[n] for n in sizes if n < x) + sum(heavy[n] for n in sizes if n >= partner)
        if cost < least:
            best, least = x, cost
    return best


def prefix_keys(values: np.ndarray, sketch: np.ndarray, heavy_from: int, like: Likeness) -> np.ndarray:
    """The keys of a set: subsets of its prefix if it is light, single shingles if it is heavy or may be a heavy one's partner."""
    n = len(values)
    short = n - like.overlap(n) + 1
    count = np.minimum(sketch[_buckets(values)], (1 << 24) - 1).astype(np.uint64)
    rank = (count << np.uint64(40)) | (values >> np.uint64(24))
    # Values are sorted, so a stable sort breaks ties the same way in every set.
    order = np.argsort(rank, kind="stable")[: short + 1]
    first = values[order]
    found = []
    if n < heavy_from and n > 1:
        i, j = np.triu_indices(min(short + 1, n), 1)
        found.append(mix(first[i] * np.uint64(0x9E3779B97F4A7C15) + mix(first[j])))
    if n >= like.overlap(heavy_from):
        found.append(first[:short])
    return np.concatenate(found) if found else first[:0]


def live_lists(docs: DataFrame, facts: DataFrame, sketch: np.ndarray, like: Likeness) -> tuple[DataFrame, int]:
    """Entries (key, node, n, d) of the lists that hold two different sets, where d is in how many lists the set is;
    and the size from which sets are in lists of single shingles."""
    capped = F.least("n", F.lit(LARGEST_LIGHT)).cast("int")
    sizes = {r["s"]: r["count"] for r in facts.filter("n > 0").groupBy(capped.alias("s")).count().collect()}
    heavy_from = boundary(sizes, like)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, data, offsets in chunks(batches):
            nodes, counts, lists = [], [], []
            for values in shingle_sets(data, offsets, like.width):
                node = set_hash(values)
                if len(values) and node not in seen:
                    seen.add(node)
                    nodes.append(node)
                    counts.append(len(values))
                    lists.append(prefix_keys(values, sketch, heavy_from, like).view(np.int64))
            if nodes:
                bounds = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
                packed = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(lists)))
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(counts, pa.int64()), packed], names=["node", "n", "keys"])

    emitted = materialize(docs.select("text").mapInArrow(keys, "node long, n long, keys array<long>"), "keys")
    listed = emitted.select("node", F.explode("keys").alias("key")).groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"))
    live = materialize(listed.filter("lo < hi").select("key"), "live")
    held = key_filter(live, live.count())

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(2)
            values, lengths = key.flatten().to_numpy(), np.diff(key.offsets.to_numpy())
            keep = may_hold(held, values)
            of = np.repeat(np.arange(batch.num_rows), lengths)[keep]
            yield pa.RecordBatch.from_arrays([pa.array(values[keep]), batch.column(0).take(pa.array(of)), batch.column(1).take(pa.array(of))], names=["key", "node", "n"])

    entries = materialize(emitted.mapInArrow(thin, "key long, node long, n long").join(live, "key").distinct(), "entries")
    degree = entries.groupBy("node").agg(F.count("*").alias("d"))
    return materialize(entries.join(degree, "node").select("key", "node", "n", "d"), "lists"), like.overlap(heavy_from)


class Corpus(NamedTuple):
    """What the tests of pairs need."""

    docs: DataFrame
    facts: DataFrame
    like: Likeness
    listed_from: int
    sketch: np.ndarray


def sets_of(corpus: Corpus, nodes: DataFrame) -> DataFrame:
    """(node, n, items) of the given nodes, from one document each: only their texts are shuffled."""
    like = corpus.like
    wanted = corpus.facts.groupBy("node").agg(F.min("loc").alias("loc")).join(nodes, "node")
    wanted = materialize(wanted, "wanted")
    held = key_filter(wanted.select("loc"), wanted.count())

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(may_hold(held, batch.column(0).to_numpy(zero_copy_only=False))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in chunks(batches):
            kept = [(node, len(s), s) for node, s in zip(rows.column(0).to_pylist(), shingle_sets(data, offsets, like.width)) if set_hash(s) == node]
            if kept:
                bounds = np.concatenate([[0], np.cumsum([n for _, n, _ in kept])]).astype(np.int32)
                items = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate([s for _, _, s in kept]).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in kept], pa.int64()), pa.array([n for _, n, _ in kept], pa.int64()), items], names=["node", "n", "items"])

    texts = located(corpus.docs).select("loc", "text").mapInArrow(thin, "loc long, text string").join(wanted, "loc")
    # Repeated rows have one place; the join has them together already.
    texts = texts.dropDuplicates(["loc", "node"]).select("node", "text")
    return materialize(texts.mapInArrow(run, "node long, n long, items array<long>"), "items")


# --- links and components ---------------------------------------------------------------------


def once(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) with a < b, each once; written."""
    return materialize(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")


def verify(pairs: DataFrame, corpus: Corpus) -> DataFrame:
    """The written pairs (a, b) whose whole sets are alike enough."""
    if pairs.isEmpty():
        return pairs
    sets = sets_of(corpus, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    a = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("items").alias("ia"))
    b = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("items").alias("ib"))
    shared = F.size(F.array_intersect("ia", "ib"))
    tested = pairs.join(a, "a").join(b, "b").filter(_sizes_fit(F.col("na"), F.col("nb"), corpus.like))
    alike = tested.filter(100 * shared >= corpus.like.percent * (F.col("na") + F.col("nb") - shared))
    return materialize(alike.select("a", "b").distinct(), "links")


def _common_lists(na: Column, nb: Column, corpus: Corpus) -> Column:
    """In how many lists two alike sets of these sizes are together at least.

    Of the shorter prefix in the global order, no more are missing in the other set
    than the likeness allows, and the rest are in the other's prefix too.
    """
    percent = corpus.like.percent
    shared = F.ceil(percent * (na + nb) / (100 + percent))
    prefix = lambda n: n - F.ceil(percent * n / 100) + 1
    least = F.least(prefix(na) - (na - shared), prefix(nb) - (nb - shared))
    return F.when((na < corpus.listed_from) | (nb < corpus.listed_from), 1).otherwise(F.greatest(least, F.lit(1)))


def _may_link(corpus: Corpus) -> Column:
    """What columns na, da and nb, db (sizes, numbers of lists) of alike sets must meet."""
    na, nb = F.col("na"), F.col("nb")
    return _sizes_fit(na, nb, corpus.like) & (F.least("da", "db") >= _common_lists(na, nb, corpus))


def _sizes_fit(a: Column, b: Column, like: Likeness) -> Column:
    return 100 * F.least(a, b) >= like.percent * F.greatest(a, b)


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for all ends of edges (a, b): the least node that can be reached.

    Labels spread along edges and are then replaced by their own labels, until nothing changes.
    """
    both = materialize(edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        spread = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        target = labels.select(F.col("node").alias("mid"), F.col("label").alias("far"))
        jumped = materialize(spread.join(target, "mid").select("node", "old", F.least("mid", "far").alias("label")), "labels")
        labels = jumped.select("node", "label")
        if jumped.filter("old != label").isEmpty():
            return labels


def _join_labels(labels: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """Labels after links between nodes (given with their labels) are added."""
    if links.isEmpty():
        return labels
    if labels is None:
        return components(links)
    at = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))
    ends = links.join(at("a"), "a", "left").join(at("b"), "b", "left")
    ends = ends.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).filter("a != b").distinct()
    merged = components(ends).select(F.col("node").alias("label"), F.col("label").alias("to"))
    known = labels.unionAll(merged.select(F.col("label").alias("node"), "label")).distinct()
    # A large component is one label: its nodes are spread.
    known = known.withColumn("salt", F.pmod("node", F.lit(SALTS)).cast("int"))
    merged = merged.withColumn("salt", F.explode(F.array(*[F.lit(k) for k in range(SALTS)])))
    return materialize(known.join(merged, ["label", "salt"], "left").select("node", F.coalesce("to", "label").alias("label")), "labels")


def _labelled(lists: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return lists.withColumn("label", F.col("node"))
    return lists.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _entry(name: str) -> list[Column]:
    """The columns of an entry as those of one side of a pair."""
    return [F.col("node").alias(name), F.col("n").alias(f"n{name}"), F.col("d").alias(f"d{name}")]


def size_class(n: Column, like: Likeness) -> Column:
    """Sizes of alike sets lie in the same class or in neighbouring ones; the small excess keeps rounding out."""
    return F.floor(F.log(n.cast("double")) / (log(100 / like.percent) * 1.0001)).cast("int")


def _mixed_lists(lists: DataFrame, labels: DataFrame | None, like: Likeness) -> DataFrame:
    """Entries of lists cut by size, where these hold several components: (key, low, size, hub, node, n, d, class, label).

    A part ``low`` of a list has the sets of two neighbouring size classes. ``hub`` is the most central set of the
    part's largest component, ``members`` the number of its sets.
    """
    entries = _labelled(lists, labels).withColumn("class", size_class(F.col("n"), like))
    parts = entries.withColumn("low", F.explode(F.array(F.col("class") - 1, F.col("class"))))
    one = parts.groupBy("key", "low", "label").agg(F.count("*").alias("c"), F.max(F.struct("d", "node")).alias("hub"))
    whole = one.groupBy("key", "low").agg(F.count("*").alias("m"), F.sum("c").alias("members"), F.max(F.struct("c", "hub")).alias("of"))
    mixed = whole.filter("m > 1").select("key", "low", "members", F.col("of.hub.node").alias("hub"))
    return materialize(parts.join(mixed, ["key", "low"]), "mixed")


def _pairs_of_small(mixed: DataFrame, corpus: Corpus) -> DataFrame:
    """Pairs of different components in small parts, as often together as their sizes ask for.

    Pairs that are together in a large part as well may be counted too low here; these meet by their deltas.
    """
    small = mixed.filter(F.col("members") <= SMALL_PART)
    side = lambda x: small.select("key", "low", *_entry(x), F.col("class").alias(f"class_{x}"), F.col("label").alias(f"l{x}"))
    once_each = (F.col("a") < F.col("b")) & (F.col("low") == F.least("class_a", "class_b"))
    met = side("a").join(side("b"), ["key", "low"]).filter(once_each & (F.col("la") != F.col("lb")) & _may_link(corpus))
    times = met.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("c"))
    return times.filter(F.col("c") >= _common_lists(F.col("na"), F.col("nb"), corpus)).select("a", "b")


def _central_pairs(lists: DataFrame, corpus: Corpus) -> DataFrame:
    """Each set with the most central one of its lists: the one that is in most lists, as the origin of copies is."""
    hubs = lists.groupBy("key").agg(F.max(F.struct("d", "node", "n")).alias("h"))
    hubs = hubs.select("key", F.col("h.node").alias("b"), F.col("h.n").alias("nb"), F.col("h.d").alias("db"))
    met = lists.select("key", *_entry("a")).join(hubs, "key").filter((F.col("a") != F.col("b")) & _may_link(corpus))
    times = met.groupBy("a", "b").agg(F.count("*").alias("c"))
    return times.groupBy("a").agg(F.max(F.struct("c", "b")).alias("h")).select("a", F.col("h.b").alias("b"))


# --- deltas -----------------------------------------------------------------------------------


def _deltas(met: DataFrame, corpus: Corpus) -> DataFrame:
    """For pairs (node, hub): what the set has beyond the hub's (``added``) and lacks of it (``lacking``), written.

    Two sets of sizes na, nb that lack la, lb of a hub of size nh share nh - la - lb and what their deltas share. They
    link if that is at least p (na + nb) / (100 + p). So their deltas share the sum of their ``dues``, over 2 (100 + p),
    or more. ``out``: the set itself does not link with the hub.
    """
    p = corpus.like.percent
    nodes = met.select(F.explode(F.array("node", "hub")).alias("node")).distinct()
    sets = sets_of(corpus, nodes)
    hubs = sets.select(F.col("node").alias("hub"), F.col("n").alias("nh"), F.col("items").alias("hub_items"))
    both = met.join(sets, "node").join(hubs, "hub")
    both = both.select("hub", "node", "n", "nh", F.array_except("items", "hub_items").alias("added"), F.array_except("hub_items", "items").alias("lacking"))
    lacks = F.size("lacking")
    shared = F.col("nh") - lacks
    due = 2 * p * F.col("n") + (100 + p) * (2 * lacks - F.col("nh"))
    out = 100 * shared < p * (F.col("n") + F.col("nh") - shared)
    return materialize(both.select("hub", "node", "n", "added", "lacking", due.alias("due"), out.alias("out")), "deltas")


def _due(a: Column, b: Column, like: Likeness) -> Column:
    """How many shingles the deltas of two linked sets share at least, one of which is not linked with the hub."""
    return F.greatest(F.ceil((a + b) / (2 * (100 + like.percent))), F.lit(1))


def _delta_prefixes(deltas: DataFrame, corpus: Corpus) -> DataFrame:
    """(hub, token, at, node, n, size, due, out): the first shingles of each delta, as many as any partner asks for.

    What sets have beyond the hub comes first, rare ones of the corpus ahead; then what they lack, by how few lack it.
    """
    least = deltas.groupBy("hub").agg(F.min("due").alias("any"), F.min(F.when(F.col("out"), F.col("due"))).alias("outer")).filter("outer is not null")
    size = F.size("added") + F.size("lacking")
    # A set that links with the hub only needs partners that do not.
    asked = _due(F.col("due"), F.when(F.col("out"), F.col("any")).otherwise(F.col("outer")), corpus.like)
    held = deltas.join(least, "hub").withColumn("size", size).withColumn("keep", size - asked + 1).filter("keep > 0").drop("any", "outer")
    lacked = held.select("hub", F.explode("lacking").alias("token")).groupBy("hub", "token").agg(F.count("*").alias("c"))
    order = lacked.groupBy("hub").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "token"))), lambda x: x["token"]).alias("order"))
    sketch = corpus.sketch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, places, counts = [], [], []
            for added, lacking, order, keep in zip(*(batch.column(k) for k in range(4))):
                own = np.asarray(added.values.to_numpy(zero_copy_only=False), np.int64).view(np.uint64)
                own = own[np.lexsort((own, sketch[_buckets(own)]))].view(np.int64)[: keep.as_py()]
                rest = keep.as_py() - len(own)
                if rest > 0 and order.is_valid:
                    ranked = order.values.to_numpy(zero_copy_only=False)
                    own = np.concatenate([own, ranked[np.isin(ranked, lacking.values.to_numpy(zero_copy_only=False))][:rest]])
                tokens.append(own)
                places.append(np.arange(len(own), dtype=np.int32))
                counts.append(len(own))
            of = pa.array(np.repeat(np.arange(batch.num_rows), counts))
            rest = [batch.column(k).take(of) for k in range(4, batch.num_columns)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([*tokens, np.zeros(0, np.int64)]).astype(np.int64)), pa.array(np.concatenate([*places, np.zeros(0, np.int32)]).astype(np.int32)), *rest],
                names=["token", "at", "hub", "node", "n", "size", "due", "out"],
            )

    held = held.join(order, "hub", "left").select("added", "lacking", "order", "keep", "hub", "node", "n", "size", "due", "out")
    return materialize(held.mapInArrow(run, "token long, at int, hub long, node long, n long, size int, due long, out boolean"), "prefixes")


def _delta_pairs(prefixes: DataFrame, labels: DataFrame | None, corpus: Corpus) -> DataFrame:
    """Pairs (a, b) of different components, a without a link to the hub, that may link by what their deltas share."""
    held = _labelled(prefixes, labels)
    side = lambda x: held.select("hub", "token", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "n", "size", "due", "out", "at", "label")])
    room = F.least(F.col("size_a") - F.col("at_a"), F.col("size_b") - F.col("at_b"))
    fits = _sizes_fit(F.col("n_a"), F.col("n_b"), corpus.like) & (room >= _due(F.col("due_a"), F.col("due_b"), corpus.like))
    apart = (F.col("label_a") != F.col("label_b")) & (~F.col("out_b") | (F.col("node_a") < F.col("node_b")))
    met = side("a").filter("out_a").join(side("b"), ["hub", "token"]).filter(apart & fits)
    return met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))


def link_components(lists: DataFrame, corpus: Corpus) -> DataFrame | None:
    """(node, label) of every set with a link; None if there is none."""
    labels = _join_labels(None, verify(once(_central_pairs(lists, corpus)), corpus))
    mixed = _mixed_lists(lists, labels, corpus.like)
    pairs = _pairs_of_small(mixed, corpus)
    large = materialize(mixed.filter((F.col("members") > SMALL_PART) & (F.col("node") != F.col("hub"))).select("node", "hub").distinct(), "large")
    if not large.isEmpty():
        deltas = _deltas(large, corpus)
        labels = _join_labels(labels, deltas.filter("not out").select(F.col("node").alias("a"), F.col("hub").alias("b")))
        pairs = pairs.unionAll(_delta_pairs(_delta_prefixes(deltas, corpus), labels, corpus))
    return _join_labels(labels, verify(once(pairs), corpus))


def labelled_documents(docs: DataFrame, like: Likeness) -> DataFrame:
    """Per document: doc_id, loc, n (size of its set) and the label of its component, null without words."""
    facts, sketch = describe(docs, like)
    lists, listed_from = live_lists(docs, facts, sketch, like)
    labels = None if lists.isEmpty() else link_components(lists, Corpus(docs, facts, like, listed_from, sketch))
    tagged = facts if labels is None else facts.join(labels, "node", "left")
    label = F.col("node") if labels is None else F.coalesce("label", "node")
    return tagged.select("doc_id", "loc", "n", F.when(F.col("n") > 0, label).alias("label"))


def jaccard_components(docs: DataFrame, like: Likeness = Likeness()) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (least doc_id that links lead to)."""
    tagged = labelled_documents(docs, like)
    # Written, so that the join reads it as it is and a large component can be split there.
    least = materialize(tagged.filter("label is not null").groupBy("label").agg(F.min("doc_id").alias("least")), "least")
    joined = tagged.join(least, "label", "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, like: Likeness = Likeness()) -> DataFrame:
    """One document of each component, that of the least doc_id, with its own columns; rows without words all stay."""
    tagged = labelled_documents(docs, like)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "loc"))
    kept = tagged.filter("label is not null").groupBy("label").agg(first.alias("first")).select(F.col("first.loc").alias("_sieve_loc"))
    rows = docs.withColumn("_sieve_loc", place())
    one = rows.join(kept, "_sieve_loc", "left_semi").dropDuplicates(["_sieve_loc"])
    empty = rows.join(tagged.filter("label is null").select(F.col("loc").alias("_sieve_loc")).distinct(), "_sieve_loc", "left_semi")
    return one.unionAll(empty).drop("_sieve_loc")
