"""Lookups along an order without one task per key: first inside a part of the axis, then among the parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_next(rows: DataFrame, marks: DataFrame, keys: list[str], at: str, part: Column, name: str, inclusive: bool = False) -> DataFrame:
    """Add ``name``: the least ``mark`` of the marks with the same keys that stand after a row's ``at`` (or at it, if
    ``inclusive``); null if there is none.

    ``marks`` has the keys, ``at`` and ``mark``, which does not fall along ``at``. ``part`` maps ``at`` to its part of the
    axis, in order. A key with many rows so is as many keys as it has parts.
    """
    least = marks.groupBy(*keys, at).agg(F.min("mark").alias("_mark"))
    # Backwards along the axis: what a row may see comes first.
    both = rows.withColumn("_row", F.lit(1)).unionByName(least.withColumn("_row", F.lit(0)), allowMissingColumns=True).withColumn("_part", part)
    tie = F.col("_row").asc() if inclusive else F.col("_row").desc()
    seen = Window.partitionBy(*keys, "_part").orderBy(F.col(at).desc(), tie).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*keys).orderBy(F.col("_part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    later = both.groupBy(*keys, "_part").agg(F.min("_mark").alias("_m")).withColumn("_later", F.min("_m").over(after)).drop("_m")
    found = both.withColumn("_inside", F.min("_mark").over(seen)).filter("_row = 1").drop("_row", "_mark")
    return found.join(later, [*keys, "_part"]).withColumn(name, F.coalesce("_inside", "_later")).drop("_part", "_inside", "_later")
