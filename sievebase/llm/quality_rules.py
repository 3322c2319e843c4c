"""Quality rules whose thresholds adapt to each language and source.

Every document gets plain counts and from them rates. For each language and
source the distribution of each rate is kept as a mergeable quantile sketch:
counts of logarithmic bins (relative-error sketch; two sketches are merged by
adding counts, so the result does not depend on partitions or order). The
thresholds are read from the sketches and joined back.

A rate's upper fence is ``median + spreads * max(median - lower quartile, floor)``;
mean word length has a lower fence as well. The half below the median is used
because junk lies above it and would widen a two-sided spread. A group of fewer
than ``min_docs`` documents takes the merged sketch of its language, or of all.

Defined cases: a null, empty or blank text has zero counts, fails the base rules
and enters no sketch; a null language or source is a group of its own; repeated
rows count as often as they occur; an empty table gives an empty result; columns
of the input that share a name with a result column are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievebase.functions.text import let
from sievebase.llm.common import SPACE_CHARS, materialize, words_of

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
GAMMA = 1.02  # ratio of neighbouring bins: values are known to one percent
SPREADS = 6.0
MIN_DOCS = 50

#: Rates with the least spread that their fence allows for.
FLOORS = {
    "symbol_rate": 0.01, "other_rate": 0.02, "upper_rate": 0.03, "dup_line_rate": 0.08, "repeat_rate": 0.05,
    "mean_word": 0.4,
}
TWO_SIDED = ("mean_word",)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _covered_words(keys: Column) -> Column:
    """Words inside windows whose key occurs again, from the keys of all windows in order.

    Sorted by key, equal windows are neighbours; sorted by place again, each covers
    the words up to the next one, a window's width at most. ``let`` binds the sorted
    arrays, so that lambdas read them and never compute them.
    """
    placed = F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))

    def again(p: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(p, j)["k"] == x["k"], F.lit(False))
        return F.sort_array(F.array_compact(F.transform(p, lambda x, j: F.when(same(x, j - 1) | same(x, j + 1), x["i"]))))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(at, j + 1) - x, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    return let(let(placed, again), covered)


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Documents with the counts and rates of their texts; the text is split once."""
    added = ["_words", "_keys", "_lines", "_covered", *COUNTS, "base_failed", *FLOORS]
    df = docs.drop(*[c for c in added if c in docs.columns])
    body = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("_words", words_of(F.col(text)))
    df = df.withColumn(
        "_keys",
        F.when(
            F.size("_words") >= WINDOW,
            F.transform(F.sequence(F.lit(1), F.size("_words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_words", i, WINDOW))),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    df = df.withColumn("_lines", F.filter(F.split(body, "\n"), lambda x: F.length(F.trim(x, F.lit(SPACE_CHARS))) > 0))
    # Only texts in which a window occurs again are sorted.
    repeated = F.size(F.array_distinct("_keys")) < F.size("_keys")
    df = df.withColumn("_covered", F.when(repeated, _covered_words(F.col("_keys"))).otherwise(0))
    joined = F.array_join("_words", "")
    df = df.select(
        *[c for c in df.columns if not c.startswith("_") or c in docs.columns],
        F.size("_words").cast("long").alias("n_words"),
        F.length(joined).cast("long").alias("word_chars"),
        (F.length(body) - F.length(F.regexp_replace(body, "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.col("_covered").cast("long").alias("n_repeat_words"),
        F.size("_lines").alias("_n_lines"),
        F.length(F.regexp_replace(joined, r"[\p{L}\p{M}]+", "")).alias("_n_other"),
        F.length(F.regexp_replace(body, r"[^\p{Lu}]+", "")).alias("_n_upper"),
    )
    chars, words = F.col("word_chars").cast("double"), F.col("n_words").cast("double")
    has_words = F.col("n_words") > 0

    def rate(part: str, whole: Column) -> Column:
        return F.when(has_words, F.col(part) / whole)

    return df.select(
        *[c for c in df.columns if c not in ("_n_lines", "_n_other", "_n_upper")],
        rate("n_symbols", chars).alias("symbol_rate"),
        rate("_n_other", chars).alias("other_rate"),
        rate("_n_upper", chars).alias("upper_rate"),
        rate("n_dup_lines", F.col("_n_lines").cast("double")).alias("dup_line_rate"),
        rate("n_repeat_words", words).alias("repeat_rate"),
        rate("word_chars", words).alias("mean_word"),
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))).alias("base_failed"),
    )


def sketches(counted: DataFrame) -> DataFrame:
    """Bins of each rate per language and source: (lang, source, rule, bin, n). Bin -2**31 holds zeros."""
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("x")) for r in FLOORS])).alias("r")
    rows = counted.select("lang", "source", rules).filter(F.col("r.x").isNotNull())
    place = F.when(F.col("r.x") <= 0, -(2**31)).otherwise(F.ceil(F.log(F.col("r.x")) / math.log(GAMMA)).cast("int"))
    return rows.groupBy("lang", "source", F.col("r.rule").alias("rule"), place.alias("bin")).agg(F.count("*").alias("n"))


def _quantiles(bins: DataFrame, *keys: str) -> DataFrame:
    """Number of values, median and lower quartile of each sketch; equal sketches are merged first."""
    merged = bins.groupBy(*keys, "rule", "bin").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "rule")
    below = F.sum("n").over(group.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = merged.select(*keys, "rule", "bin", below.alias("upto"), F.sum("n").over(group).alias("total"))
    value = F.when(F.col("bin") == -(2**31), 0.0).otherwise(2 * F.pow(F.lit(GAMMA), F.col("bin")) / (GAMMA + 1))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("total"), value))
    return ranked.groupBy(*keys, "rule").agg(F.max("total").alias("docs"), at(0.5).alias("mid"), at(0.25).alias("low"))


def thresholds(bins: DataFrame, spreads: float = SPREADS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Fences per language and source, one row each: lang, source, <rule>_max, mean_word_min."""
    own = _quantiles(bins, "lang", "source").alias("o")
    of_lang = _quantiles(bins, "lang").alias("l")
    of_all = _quantiles(bins).alias("a")
    joined = own.join(of_lang, F.col("o.lang").eqNullSafe(F.col("l.lang")) & (F.col("o.rule") == F.col("l.rule"))).join(
        of_all, F.col("o.rule") == F.col("a.rule")
    )

    def chosen(c: str) -> Column:
        return (
            F.when(F.col("o.docs") >= min_docs, F.col(f"o.{c}")).when(F.col("l.docs") >= min_docs, F.col(f"l.{c}")).otherwise(F.col(f"a.{c}"))
        )

    floor = F.create_map(*[F.lit(x) for pair in FLOORS.items() for x in pair])[F.col("o.rule")]
    mid, low = chosen("mid"), chosen("low")
    reach = spreads * F.greatest(mid - low, floor)
    rows = joined.select(F.col("o.lang").alias("lang"), F.col("o.source").alias("source"), F.col("o.rule").alias("rule"), (mid + reach).alias("hi"), (mid - reach).alias("lo"))
    return rows.groupBy("lang", "source").agg(
        *[F.max(F.when(F.col("rule") == r, F.col("hi"))).alias(f"{r}_max") for r in FLOORS],
        *[F.max(F.when(F.col("rule") == r, F.col("lo"))).alias(f"{r}_min") for r in TWO_SIDED],
    )


def judge(counted: DataFrame, fences: DataFrame) -> DataFrame:
    """Join the fences and decide: adds ``broken`` (names of broken rules) and ``kept``."""
    names = [c for c in fences.columns if c not in ("lang", "source")]
    counted = counted.drop(*[c for c in (*names, "broken", "kept") if c in counted.columns])
    fences = fences.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    on = counted["lang"].eqNullSafe(fences["_lang"]) & counted["source"].eqNullSafe(fences["_source"])
    df = counted.join(fences, on, "left").drop("_lang", "_source")
    tests = [F.when(F.col(r) > F.col(f"{r}_max"), F.lit(r)) for r in FLOORS]
    tests += [F.when(F.col(r) < F.col(f"{r}_min"), F.lit(f"{r}_low")) for r in TWO_SIDED]
    df = df.withColumn("broken", F.array_compact(F.array(*tests)))
    return df.withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))


def quality_rules(docs: DataFrame) -> DataFrame:
    """Counts, rates, fences and verdict per document; the counts are written once and read twice."""
    counted = with_counts(docs)
    narrow = [c for c in ("doc_id", "lang", "source") if c in counted.columns]
    counted = materialize(counted.select(*narrow, *COUNTS, *FLOORS, "base_failed"), "rules")
    return judge(counted, materialize(thresholds(sketches(counted)), "fences"))


def keep_documents(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their own columns.

    Documents are written with their rates once; the fences come from the rates, and the verdict reads both. The fences are
    a small written table, so that Spark knows their size when it plans the join.
    """
    whole = F.struct(*docs.columns).alias("_doc")
    counted = with_counts(docs.select("text", "lang", "source", whole)).select("lang", "source", *FLOORS, "base_failed", "_doc")
    counted = materialize(counted, "counted")
    fences = materialize(thresholds(sketches(counted)), "fences")
    return judge(counted, fences).filter("kept").select("_doc.*")
