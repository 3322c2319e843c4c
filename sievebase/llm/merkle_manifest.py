"""Merkle manifest of a dataset: digests of rows, subtrees and the whole, with proofs.

Method: nested-interval labels. Every node carries the interval of leaf ranks that
it covers: a node of level k covers ``[lo, hi)`` with lo a multiple of 2**k. Nodes
are built SPAN levels at a time: a bucket holds the nodes of SPAN levels inside one
interval, from its units (at most 2**SPAN) up to its top. Ancestors come from joins by
containment: a node meets the one bucket of the levels above whose interval contains its
own, from the root downward to the leaves. On each level of a bucket the parent's
interval less the node's own is the interval of its sibling.

Leaves are ranked by a range sort that is written with the place of each row; the
places of a group's runs in the sorted parts give ranks without one task per group.

The nodes are a table of their own (``Manifest.nodes``), so that parts of a dataset can
be compared from the root downward.

Defined cases: a null is hashed as ``-`` in any column; leaves of a group ascend by
doc_id, null first, then by leaf digest, and repeated rows stand side by side; a null
lang is a group of its own, before all others; a group of one leaf has that leaf as
its subroot and a single group's subroot is the root; without siblings the proof is
the hash of nothing; an empty table has no rows; further columns are ignored; a null
doc_id or n_chars is not tampered with.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievebase.llm.common import materialize

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SPAN = 8
TAMPERED_ONE_IN = 7


class Manifest(NamedTuple):
    """``leaves``: doc_id, lang, rank, leaf, changed (digest after tampering, or null), subroot, root and path, the siblings
    from the leaf up (whether to the left, and the digest; null where a node has none).
    ``nodes``: (tier, grp, level, lo, hi, digest), tier 0 below the subroots and tier 1 above them."""

    leaves: DataFrame
    nodes: DataFrame


# --- digests ----------------------------------------------------------------------------------


def field(value: Column) -> Column:
    """A value with its length ahead, so that no two rows are written alike."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(**changed: Column) -> Column:
    return _joined(*[field(changed.get(name, F.col(name))) for name in FIELDS])


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _joined(*parts: Column) -> Column:
    """The digest over digests, as binary."""
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _halved(row: Column) -> Column:
    """The digests one level up: of each two neighbours, the last of one if their number is odd."""
    pair = lambda i: _joined(_hex(F.get(row, 2 * i)), F.coalesce(_hex(F.get(row, 2 * i + 1)), F.lit("")))
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(row) - 1) / 2).cast("int")), pair)


def _height(n: Column) -> Column:
    """Levels above n leaves: the least k with 2**k >= n."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0)


def folded(leaf: Column, path: Column) -> Column:
    """The root (as hex) that a leaf's digest and its siblings lead to."""

    def up(digest: Column, sibling: Column) -> Column:
        other = F.coalesce(_hex(sibling["digest"]), F.lit(""))
        return F.sha2(F.when(sibling["left"], F.concat(other, digest)).otherwise(F.concat(digest, other)), 256)

    return F.aggregate(path, _hex(leaf), up)


def proof(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda s: _hex(s["digest"])), ""), 256)


# --- ranks ------------------------------------------------------------------------------------


def ranked(rows: DataFrame, order: list[str], group: str = "grp") -> DataFrame:
    """Add ``rank`` (from 0, along ``order``) and ``n`` (rows) within each group; written.

    Rows are sorted over the whole table, by group first, so a group is a run in each of
    some sorted parts; its runs' lengths, added up, give the ranks.
    """
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    keys = [group, *order, "_tie"]
    at = F.monotonically_increasing_id()
    part = F.shiftright("_at", 33).alias("_part")
    placed = materialize(tied.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie").withColumn("_at", at), "ranked").select("*", part)
    runs = placed.groupBy(group, "_part").agg(F.min("_at").alias("_from"), F.count("*").alias("_c"))
    window = Window.partitionBy(group).orderBy("_part")
    ahead = F.coalesce(F.sum("_c").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(group, "_part", (ahead - F.col("_from")).alias("_shift"), F.sum("_c").over(Window.partitionBy(group)).alias("n"))
    return placed.join(runs, [group, "_part"]).withColumn("rank", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


# --- nodes and paths --------------------------------------------------------------------------

PATH = "array<struct<left: boolean, digest: binary>>"


def _buckets(units: DataFrame, base: int) -> DataFrame:
    """(grp, n, top, levels) over units (grp, n, lo, digest) of level base: the digests of each level from base to
    base + SPAN inside the interval of number ``top``, by rank."""
    one = F.struct("lo", "digest")
    groups = units.groupBy("grp", "n", F.shiftright("lo", base + SPAN).alias("top")).agg(F.array_sort(F.collect_list(one)).alias("_row"))
    steps = F.least(F.lit(SPAN), _height(F.col("n")) - base)
    row = F.transform("_row", lambda x: x["digest"])
    levels = F.aggregate(
        F.when(steps > 0, F.sequence(F.lit(1), F.greatest(steps, F.lit(1)))).otherwise(F.array().cast("array<int>")),
        F.array(row),
        lambda found, _: F.concat(found, F.array(_halved(F.element_at(found, -1)))),
    )
    return groups.select("grp", "n", "top", levels.alias("levels"))


def _nodes(buckets: DataFrame, base: int) -> DataFrame:
    """The nodes of buckets, with their intervals; their units only at level 0."""
    each = buckets.select("grp", "n", "top", F.posexplode("levels").alias("_k", "_row"))
    if base:
        each = each.filter("_k > 0")
    each = each.select("grp", "n", "top", (F.col("_k") + base).alias("level"), F.posexplode("_row").alias("_i", "digest"))
    lo = F.shiftleft("top", base + SPAN) + F.expr("shiftleft(cast(_i as bigint), level)")
    return each.select("grp", "n", "level", lo.alias("lo"), F.least("n", lo + F.expr("shiftleft(1L, level)")).alias("hi"), "digest")


def _inside(lo: Column, levels: Column, top: Column, base: int) -> Column:
    """The siblings, on each level of its bucket below the top, of the node that contains the rank ``lo``."""

    def sibling(k: Column) -> Column:
        width = F.call_function("shiftleft", F.lit(1).cast("long"), k + base)
        own = lo - F.pmod(lo, width)
        parent = lo - F.pmod(lo, 2 * width)
        # The parent's interval less the node's own.
        other = F.when(own == parent, own + width).otherwise(parent)
        place = F.call_function("shiftright", other - F.shiftleft(top, base + SPAN), k + base).cast("int")
        return F.struct((other < own).alias("left"), F.get(F.get(levels, k), place).alias("digest"))

    last = F.size(levels) - 2
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), sibling)).otherwise(F.array().cast(PATH))


def forest(leaves: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """All nodes (grp, n, level, lo, hi, digest) over ranked leaves, and the written buckets of each SPAN levels."""
    units = leaves.select("grp", "n", F.col("rank").alias("lo"), "digest")
    height = leaves.agg(F.max(_height(F.col("n")))).first()[0] or 0
    buckets = [materialize(_buckets(units, 0), "buckets")]
    nodes, base = _nodes(buckets[0], 0), SPAN
    while base < height:
        ends = buckets[-1].filter(_height(F.col("n")) > base)
        units = ends.select("grp", "n", F.shiftleft("top", base).alias("lo"), F.element_at("levels", -1)[0].alias("digest"))
        buckets.append(materialize(_buckets(units, base), "buckets"))
        nodes = nodes.unionAll(_nodes(buckets[-1], base))
        base += SPAN
    return nodes, buckets


def tops(nodes: DataFrame) -> DataFrame:
    """(grp, n, digest) of the node that covers all of its group."""
    return nodes.filter(F.col("level") == _height(F.col("n"))).select("grp", "n", "digest")


def attach(leaves: DataFrame, buckets: list[DataFrame], above: DataFrame) -> DataFrame:
    """The ranked leaves with their ``path``, and the columns of ``above`` (grp, n and more), whose own path follows theirs."""
    carried = [c for c in above.columns if c not in ("grp", "n", "path")]
    known: DataFrame | None = None
    for j in reversed(range(len(buckets))):
        base, number = j * SPAN, F.shiftright("top", SPAN)
        # A group ends in this bucket, or the bucket's top lies in one of the next levels.
        ends = above.filter(_height(F.col("n")) <= base + SPAN).select("grp", *carried, "path")
        held = buckets[j].filter(_height(F.col("n")) <= base + SPAN).join(ends, "grp")
        if known is not None:
            over = known.select("grp", F.col("top").alias("_over"), F.col("levels").alias("_levels"), *carried, F.col("path").alias("_path"))
            inner = buckets[j].filter(_height(F.col("n")) > base + SPAN).withColumn("_over", number).join(over, ["grp", "_over"])
            own = _inside(F.shiftleft("top", base + SPAN), F.col("_levels"), F.col("_over"), base + SPAN)
            held = held.unionAll(inner.select("grp", "n", "top", "levels", *carried, F.concat(own, "_path").alias("path")))
        known = held
    at = leaves.withColumn("top", F.shiftright("rank", SPAN)).drop("n").join(known, ["grp", "top"])
    path = F.concat(_inside(F.col("rank"), F.col("levels"), F.col("top"), 0), "path")
    return at.withColumn("path", path).drop("levels", "top")


def dataset_manifest(docs: DataFrame) -> Manifest:
    """Digests, nodes and proofs of a table with the columns FIELDS, grouped by lang."""
    group = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))
    tampered = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED_ONE_IN == 0) & F.col("n_chars").isNotNull()
    changed = F.when(tampered, leaf_digest(n_chars=F.try_add("n_chars", F.lit(1))))
    rows = docs.select("doc_id", group.alias("grp"), leaf_digest().alias("digest"), changed.alias("changed"))
    leaves = ranked(rows, ["doc_id", "digest"])
    nodes, buckets = forest(leaves)
    groups = tops(nodes)
    upper = ranked(groups.select(F.lit("").alias("grp"), F.col("grp").alias("_group"), F.col("n").alias("_n"), "digest"), ["_group"])
    upper_nodes, upper_buckets = forest(upper)
    end = tops(upper_nodes).select("grp", "n", F.col("digest").alias("root"), F.array().cast(PATH).alias("path"))
    over = attach(upper, upper_buckets, end).select(F.col("_group").alias("grp"), F.col("_n").alias("n"), F.col("digest").alias("subroot"), "root", "path")
    held = attach(leaves, buckets, materialize(over, "groups"))
    lang = F.when(F.col("grp") != "", F.substr("grp", F.lit(2)))
    leaf_rows = held.select("doc_id", lang.alias("lang"), "rank", F.col("digest").alias("leaf"), "changed", "subroot", "root", "path")
    tier = lambda df, t: df.select(F.lit(t).alias("tier"), "grp", "level", "lo", "hi", "digest")
    return Manifest(leaf_rows, tier(nodes, 0).unionAll(tier(upper_nodes, 1)))


def verified_rows(manifest: Manifest) -> DataFrame:
    """Per leaf: its digest, subroot, root and proof, and whether the (in part tampered) row still leads to the root."""
    up = folded(F.coalesce("changed", "leaf"), F.col("path"))
    rows = manifest.leaves.withColumn("folded_root", up).withColumn("root", _hex(F.col("root")))
    return rows.select(
        "doc_id", _hex(F.col("leaf")).alias("leaf"), _hex(F.col("subroot")).alias("subroot"), "root", proof(F.col("path")).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), "rank",
    )
