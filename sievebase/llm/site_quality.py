"""Quality of documents by hierarchical empirical Bayes.

A classifier on the shape of a text (rates of symbols, capitals, repeated lines
and the like, each cut to steps) gives every document its evidence, a log
likelihood ratio. Hosts and the paths below them get posteriors from all of their
documents: a label counts as it is, another document with the classifier's
probability. A path with few documents is shrunk to its host and a host to the
global rate; how strongly, follows from how much the rates of hosts, and of paths
inside hosts, differ beyond chance (method of moments). A document's result is its
own evidence on the prior odds of its path, from which its own share is taken out.

Sites are only sums by (host, path), so a host with a third of all rows costs one
row per task. The classifier is fitted on at most ``FIT_ROWS`` labelled documents,
the first by a hash of doc_id; all else covers every document.

Defined cases: a null, empty or blank text has only the lowest steps; a null host
or path is a site of its own; repeated rows count as often as they occur; without
labels of both kinds the evidence is zero and the result is one half; several
labels of one document count as their mean; an empty table gives an empty result;
columns that share a name with a result column are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievebase.llm.common import least_hashes, materialize
from sievebase.llm.quality_rules import FLOORS, with_counts

FIT_ROWS = 20_000
STEPS = 24
RIDGE = 1.0
FEATURES = (*FLOORS, "n_words")


def _steps(values: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Column numbers of the step that each value is in (rows x features); missing values are in the lowest."""
    width = STEPS + 1
    clean = np.nan_to_num(values, nan=-1.0)
    return np.stack([np.searchsorted(c, clean[:, k], "right") + k * width for k, c in enumerate(cuts)], 1)


def fit(values: np.ndarray, good: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, float]:
    """Logistic regression on steps: cuts of each feature, weight of each step, intercept without the base rate."""
    cuts = [np.unique(np.quantile(np.nan_to_num(values[:, k], nan=-1.0), np.arange(1, STEPS) / STEPS)) for k in range(values.shape[1])]
    places = _steps(values, cuts)
    base = np.log(good.sum() / (len(good) - good.sum()))
    size = values.shape[1] * (STEPS + 1)
    weights, shift = np.zeros(size), base
    for _ in range(300):  # accelerated gradient steps; the curvature of a step is at most a quarter of its rows
        p = 1 / (1 + np.exp(-(weights[places].sum(1) + shift)))
        error = good - p
        grad = np.bincount(places.ravel(), np.repeat(error, places.shape[1]), size) - RIDGE * weights
        rows = np.bincount(places.ravel(), minlength=size) * places.shape[1] / 4 + RIDGE
        weights += grad / rows
        shift += error.sum() / (len(good) / 4)
    return cuts, weights, float(shift - base)


def evidence(df: DataFrame, cuts: list[np.ndarray], weights: np.ndarray, shift: float) -> Column:
    @F.pandas_udf("double")
    def ratio(*columns: pd.Series) -> pd.Series:
        values = np.stack([c.to_numpy(dtype=float, na_value=np.nan) for c in columns], 1)
        return pd.Series(weights[_steps(values, cuts)].sum(1) + shift)

    return ratio(*[F.col(c).cast("double") for c in FEATURES])


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(mean: float, spread: float | None, chance: float | None) -> float:
    """Prior documents of a Beta prior whose variance is what ``spread`` exceeds ``chance`` by."""
    excess = max((spread or 0.0) - (chance or 0.0), 1e-4)
    return min(max(mean * (1 - mean) / excess - 1, 1.0), 1e4)


def site_quality(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", label: str = "quality") -> DataFrame:
    """Per document: doc_id, evidence, host_rate, path_rate, quality (0 to 1), kept."""
    named = docs.select("doc_id", "text", F.col(host).alias("source"), F.col(path).alias("lang"))
    marks = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.avg(label).alias("_label"))
    counted = with_counts(named).select("doc_id", F.col("source").alias("_host"), F.col("lang").alias("_path"), *FEATURES)
    counted = materialize(counted.join(marks, "doc_id", "left"), "shapes")
    sample = least_hashes(counted.filter("_label = 0 or _label = 1"), F.xxhash64("doc_id", *FEATURES), FIT_ROWS)
    fitted = sample.select(*[F.col(c).cast("double") for c in FEATURES], "_label").toPandas()
    good = fitted["_label"].to_numpy(dtype=float)
    both = 0 < good.sum() < len(good)
    rate = float(good.mean()) if both else 0.5
    cuts, weights, shift = fit(fitted[list(FEATURES)].to_numpy(dtype=float), good) if both else ([np.zeros(0)] * len(FEATURES), np.zeros(len(FEATURES) * (STEPS + 1)), 0.0)

    scored = counted.withColumn("evidence", evidence(counted, cuts, weights, shift))
    own = F.coalesce("_label", 1 / (1 + F.exp(-(F.col("evidence") + F.lit(float(np.log(rate / (1 - rate))))))))
    scored = materialize(scored.select("doc_id", "_host", "_path", "evidence", own.alias("_own")), "evidence")
    paths = materialize(scored.groupBy("_host", "_path").agg(F.count("*").alias("n"), F.sum("_own").alias("s")), "sites")
    hosts = paths.groupBy("_host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"), F.count("*").alias("kids"))

    total = paths.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    mean = min(max((total["s"] or 0.0) / total["n"], 1e-3), 1 - 1e-3) if total["n"] else 0.5
    chance = mean * (1 - mean)
    spread = hosts.agg(F.avg((F.col("hs") / F.col("hn") - mean) ** 2).alias("v"), F.avg(chance / F.col("hn")).alias("c")).first()
    host_weight = _strength(mean, spread["v"], spread["c"])
    host_rate = (F.col("hs") + host_weight * mean) / (F.col("hn") + host_weight)
    tree = paths.join(hosts.withColumn("host_rate", host_rate).withColumnRenamed("_host", "_h"), F.col("_host").eqNullSafe(F.col("_h"))).drop("_h")
    inner = tree.filter("kids > 1").agg(F.avg((F.col("s") / F.col("n") - F.col("hs") / F.col("hn")) ** 2).alias("v"), F.avg(chance / F.col("n")).alias("c")).first()
    path_weight = _strength(mean, inner["v"], inner["c"])
    sites = materialize(tree.select(F.col("_host").alias("_h"), F.col("_path").alias("_p"), "n", "s", "hn", "hs"), "rates")

    joined = scored.join(sites, scored["_host"].eqNullSafe(sites["_h"]) & scored["_path"].eqNullSafe(sites["_p"]))
    without = lambda s, n, prior, w: (F.col(s) - F.col("_own") + w * prior) / (F.col(n) - 1 + w)
    joined = joined.withColumn("host_rate", without("hs", "hn", F.lit(mean), host_weight))
    joined = joined.withColumn("path_rate", without("s", "n", F.col("host_rate"), path_weight))
    bounded = F.least(F.greatest("path_rate", F.lit(1e-4)), F.lit(1 - 1e-4))
    odds = F.col("evidence") + _logit(bounded) if both else F.lit(0.0)
    result = joined.withColumn("quality", 1 / (1 + F.exp(-odds)))
    return result.select("doc_id", "evidence", "host_rate", "path_rate", "quality", (F.col("quality") >= 0.5).alias("kept"))
