"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a random but repeatable order, gone
through again up to ``cap`` times. A document's virtual finish time is the number
of words its queue has sent when it ends, divided by the source's target. All
queues are served in order of finish time, up to the budget, which is the size
of all documents. At time 1 every source has sent its target, so the mix meets
all targets at once and any prefix of it has nearly the same shares.

Sums along a queue come from three small steps instead of one task per source:
totals of (source, slice of the random order), their running sum, and a window
inside each slice. The cut at the budget is found in the same way: totals of
slices of the time axis, of finer ones inside the slice that holds it, and the exact
place inside the last. The sources themselves (``targets``) are sorted in one task: there
are as many rows as sources.

Defined cases: a null or blank text has size 0 and is never taken; a null source
is a queue of its own and comes last; equal rows are separate documents; a null
doc_id is ordered like an empty one; an empty table or one without words takes
nothing; input columns named like result columns are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievebase.llm.common import materialize, word_count

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = "mix-1"
LEAST_SLICES = 256
SLICE_ROWS = 50_000
TIME_SLICES = 4096
CUT_ROWS = 50_000
LEVELS = 4  # 4096**4 times a time still is a whole number in a double's range
ADDED = ("size", "source_size", "target", "taken", "_source", "_u", "_slice", "_sent", "_rank")


def with_sizes(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the size in words, the source's key and a 60-bit random place."""
    place = F.conv(F.substring(F.md5(F.concat(F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 15), 16, 10)
    docs = docs.drop(*[c for c in ADDED if c in docs.columns])
    return docs.select(
        "*", word_count(F.col(text)).alias("size"),
        F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null")).alias("_source"), place.cast("long").alias("_u"),
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Per source key: size, rank and target, from rows of (key, source size).

    A target is ``min(cap * size, level * weight)`` with one level for all. Sorted
    by the level at which they stop, the first source that does not stop at the
    level of those from it on gives the level; after it, levels fall.
    """
    null_last = (F.col("_source") == "null").cast("int")
    ranked = sizes.withColumn("_rank", F.row_number().over(Window.orderBy(null_last, "_source")) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("_rank") % len(weights) + 1)
    ranked = ranked.withColumn("_w", weight).withColumn("_stop", cap * F.col("source_size") / F.col("_w"))
    order = Window.orderBy("_stop", "_rank")
    everything = Window.partitionBy()
    stopped = F.coalesce(F.sum(cap * F.col("source_size")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("_w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = (F.sum("source_size").over(everything) - stopped) / rest
    leveled = ranked.withColumn("_level", level)
    final = F.max(F.when(F.col("_level") <= F.col("_stop"), F.col("_level"))).over(everything)
    target = F.least((cap * F.col("source_size")).cast("double"), F.coalesce(final, F.lit(0.0)) * F.col("_w"))
    return leveled.select("_source", "source_size", "_rank", target.alias("target"))


def timeline(sized: DataFrame, narrow: DataFrame) -> DataFrame:
    """Documents with their source's size and target and the words its queue has sent with them in one round.

    ``narrow`` holds the same rows with at least (_source, size, _u); it is read for the totals.
    """
    rows = narrow.count()
    bits = max(LEAST_SLICES.bit_length() - 1, (rows // SLICE_ROWS).bit_length())
    piece = F.shiftright("_u", 60 - bits)
    totals = materialize(narrow.groupBy("_source", piece.alias("_slice")).agg(F.sum("size").alias("_total")), "slices")
    queue = Window.partitionBy("_source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("_source", "_slice", F.coalesce(F.sum("_total").over(queue), F.lit(0)).alias("_before"))
    goal = targets(totals.groupBy("_source").agg(F.sum("_total").alias("source_size")))
    offsets = materialize(before.join(goal, "_source"), "offsets")
    inside = Window.partitionBy("_source", "_slice").orderBy("_u", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = sized.withColumn("_slice", piece).withColumn("_inside", F.sum("size").over(inside))
    return placed.join(offsets, ["_source", "_slice"]).withColumn("_sent", F.col("_before") + F.col("_inside")).drop("_inside", "_before", "_slice")


def _finish(round_: int) -> Column:
    return (F.lit(round_) * F.col("source_size") + F.col("_sent")) / F.col("target")


def _time_slice(time: Column, level: int = 1) -> Column:
    """The slice of a time: TIME_SLICES to the unit, each cut into TIME_SLICES at the next level; times from 2 on are one."""
    place = F.floor(time * float(TIME_SLICES**level))
    return F.least(place, F.lit(2 * TIME_SLICES - 1)) if level == 1 else place


def with_taken(placed: DataFrame, cap: int = CAP) -> DataFrame:
    """Cut the merged order at the budget and add ``taken``, the words that the mix takes of each document.

    The cut is looked for in ever finer slices, until the one that holds it has at most CUT_ROWS sends.
    """
    real = (F.col("size") > 0) & (F.col("target") > 0)
    key = lambda r: F.struct(_finish(r).alias("f"), F.col("_rank").alias("k"), F.col("_u").alias("u"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"))
    sends = placed.filter(real).select("size", F.explode(F.array(*[key(r) for r in range(cap)])).alias("key"))
    left = placed.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    edges: list[int] = []
    while True:
        level = len(edges) + 1
        slice_ = _time_slice(F.col("key.f"), level)
        totals = sends.groupBy(slice_.alias("slice")).agg(F.sum("size").alias("n"), F.count("*").alias("rows"))
        upto = F.sum("n").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        edge = totals.select("slice", "n", "rows", upto.alias("upto")).filter(F.col("upto") > left).orderBy("slice").first()
        if edge is None:
            break
        edges.append(edge["slice"])
        left -= edge["upto"] - edge["n"]
        sends = sends.filter(slice_ == edge["slice"])
        if edge["rows"] <= CUT_ROWS or level == LEVELS or edge["slice"] == 2 * TIME_SLICES - 1:
            break
    if not edges:
        return placed.withColumn("taken", F.lit(0).cast("long"))
    place = Window.orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = sends.select("key", F.sum("size").over(place).alias("upto"))
    last = inside.filter(F.col("upto") <= left).agg(F.max("key").alias("key")).first()["key"]

    def sent(r: int) -> Column:
        # Before the edge of the first level at which it is not on it, or not after the last one that is taken.
        found = F.lit(False)
        if last is not None:
            found = key(r) <= F.struct(F.lit(last["f"]).alias("f"), F.lit(last["k"]).alias("k"), F.lit(last["u"]).alias("u"), F.lit(last["d"]).alias("d"))
        for level in range(len(edges), 0, -1):
            slice_ = _time_slice(_finish(r), level)
            found = (slice_ < edges[level - 1]) | ((slice_ == edges[level - 1]) & found)
        return found.cast("long")

    times = sum((sent(r) for r in range(1, cap)), sent(0))
    return placed.withColumn("taken", F.when(real, F.col("size") * times).otherwise(F.lit(0)).cast("long"))


def mix_sources(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, taken. The text is read once."""
    sized = materialize(with_sizes(docs).select("doc_id", "source", "size", "_source", "_u"), "sizes")
    placed = materialize(timeline(sized, sized), "timeline")
    return with_taken(placed).select("doc_id", "source", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it is taken, with its own columns.

    Only the queue windows carry texts; totals and the cut read narrow columns.
    """
    whole = F.struct(*docs.columns).alias("_doc")
    sized = with_sizes(docs.select("doc_id", "source", "text", whole))
    narrow = materialize(sized.select("doc_id", "size", "_source", "_u"), "sizes")
    placed = timeline(sized.drop("text"), narrow)
    taken = with_taken(placed).filter("taken > 0")
    return taken.select("_doc", F.explode(F.sequence(F.lit(1), (F.col("taken") / F.col("size")).cast("int")))).select("_doc.*")
