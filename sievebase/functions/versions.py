"""Version comparison as array comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def version_parts(version: Column) -> Column:
    """Numbers of a dotted version cut at the first dash; other parts count as zero."""
    return F.transform(
        F.split(F.substring_index(version, "-", 1), r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(0))
    )


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1.

    Arrays compare element by element but a shorter array ranks below its own
    extension, so both sides are first padded with zeros to the longer one.
    """
    pa, pb = version_parts(a), version_parts(b)
    width = F.greatest(F.size(pa), F.size(pb))
    ka = F.concat(pa, F.array_repeat(F.lit(0), width - F.size(pa)))
    kb = F.concat(pb, F.array_repeat(F.lit(0), width - F.size(pb)))
    return F.when(ka < kb, -1).when(ka > kb, 1).otherwise(0)


def older(a: Column, b: Column) -> Column:
    """True where version ``a`` ranks below version ``b``."""
    return compare(a, b) < 0
