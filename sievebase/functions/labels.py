"""Display labels for sizes, durations and ages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def size_label(kb: Column) -> Column:
    mb = kb / 1024.0
    return F.when(mb >= 1024, F.format_string("%.2f GB", F.round(mb / 1024, 2))).otherwise(
        F.format_string("%.1f MB", F.round(mb, 1))
    )


def eta_label(kb: Column) -> Column:
    """Time to download at five megabits per second."""
    seconds = F.floor(kb * 8 / 5120.0)
    return F.when(
        kb * 8 / 5120.0 > 60,
        F.concat(F.floor(seconds / 60).cast("string"), F.lit("m "), (seconds % 60).cast("string"), F.lit("s")),
    ).otherwise(F.concat(seconds.cast("string"), F.lit("s")))


def duration_label(ms: Column) -> Column:
    minutes, seconds = F.floor(ms / 60000), F.floor(ms % 60000 / 1000)
    return (
        F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms")))
        .when(ms < 60000, F.format_string("%.1fs", F.round(ms / 1000.0, 1)))
        .otherwise(F.concat(minutes.cast("string"), F.lit("m "), seconds.cast("string"), F.lit("s")))
    )


def age_label(when: Column, as_of: str) -> Column:
    """How long ago, seen from ``as_of``."""
    seconds = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(when.cast("timestamp"))

    def ago(unit: int, name: str) -> Column:
        return F.concat(F.floor(seconds / unit).cast("string"), F.lit(f" {name} ago"))

    return (
        F.when(seconds < 60, "just now").when(seconds < 3600, ago(60, "mins")).when(seconds < 86400, ago(3600, "hours"))
        .when(seconds < 7 * 86400, ago(86400, "days")).otherwise(F.date_format(when, "MMM dd, yyyy"))
    )
