"""The plan quota with each user's own reset date.

Every scan request first resets a user's count if the reset date has come (or there is none): the count becomes 0 and
the date a month after the request. Then a request of a free user is rejected if the limit is used up, else if the
repository is private; what is not rejected counts.

So a user's requests fall into periods: one ends where the first request at least a month after its start opens the
next. Each request's successor, that first request, comes from a lookup along time in parts of a month; periods are
what the first request reaches over successors, found by pointer doubling. So a user with many requests is as many keys
as it has months, and no request waits for the one before it.

``requests``: scan_id, user_id, created_at, is_private. ``users``: user_id, plan_type, reset_date and scans_this_month
(both may be null). Requests of one time are in order of scan_id. Users who are not free are never rejected.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievebase.functions.ranges import with_next

FREE_SCANS = 3
Store = Callable[[DataFrame, str], DataFrame]


def _month(at: Column) -> Column:
    return F.year(at) * 12 + F.month(at)


def _month_later(at: Column) -> Column:
    return at + F.expr("INTERVAL 1 MONTH")


def period_starts(requests: DataFrame, users: DataFrame, store: Store) -> DataFrame:
    """(user_id, start): the requests' times at which a user's count is reset."""
    times = requests.join(users.select("user_id", "reset_date"), "user_id").select("user_id", F.col("created_at").alias("at"), "reset_date").distinct()
    times = store(times, "times")
    first = times.filter(F.col("reset_date").isNull() | (F.col("at") >= F.col("reset_date"))).groupBy("user_id").agg(F.min("at").alias("start"))
    marks = times.select("user_id", F.col("at").alias("due"), F.col("at").alias("mark"))
    rows = times.select("user_id", "at", _month_later(F.col("at")).alias("due"))
    jumps = with_next(rows, marks, ["user_id"], "due", _month(F.col("due")), "to", inclusive=True)
    jumps = store(jumps.filter("to is not null").select("user_id", "at", "to"), "jumps")
    starts = store(first, "starts")
    while not jumps.isEmpty():
        # All periods up to 2**k after the first are known; a jump leads over 2**k.
        ahead = starts.join(jumps.withColumnRenamed("at", "start"), ["user_id", "start"]).select("user_id", F.col("to").alias("start"))
        starts = store(starts.unionAll(ahead).distinct(), "starts")
        further = jumps.select("user_id", F.col("at").alias("to"), F.col("to").alias("_to"))
        jumps = store(jumps.join(further, ["user_id", "to"]).select("user_id", "at", F.col("_to").alias("to")), "jumps")
    return starts


def judged_requests(requests: DataFrame, users: DataFrame, store: Store) -> DataFrame:
    """Every request of a known user with its period (``start``, null before the stored reset date) and ``reason`` (null if
    it is accepted)."""
    starts = period_starts(requests, users, store)
    # A request is less than a month after its period's start, so in the same calendar month or the next.
    begun = starts.withColumn("_month", F.explode(F.array(_month(F.col("start")), _month(F.col("start")) + 1)))
    plans = users.select("user_id", "plan_type", F.coalesce("scans_this_month", F.lit(0)).alias("_used"))
    held = requests.join(plans, "user_id").withColumn("_month", _month(F.col("created_at")))
    same = [held["user_id"] == begun["user_id"], held["_month"] == begun["_month"], begun["start"] <= held["created_at"], held["created_at"] < _month_later(begun["start"])]
    placed = held.join(begun, same, "left").select(held["scan_id"], held["user_id"], held["plan_type"], held["created_at"], held["is_private"], held["_used"], begun["start"])
    placed = store(placed, "placed")
    place = F.struct("created_at", "scan_id")
    left = F.when(F.col("start").isNull(), F.greatest(F.lit(0), FREE_SCANS - F.col("_used"))).otherwise(FREE_SCANS)
    # The last request that the limit lets through; only the first few of a period are ranked.
    free = placed.filter((F.col("plan_type") == "FREE") & ~F.col("is_private")).withColumn("_left", left)
    rank = F.row_number().over(Window.partitionBy("user_id", "start").orderBy("created_at", "scan_id"))
    few = free.withColumn("_rank", rank).filter(F.col("_rank") <= FREE_SCANS).filter(F.col("_rank") == F.col("_left"))
    last = few.select(F.col("user_id").alias("_user"), F.col("start").alias("_start"), place.alias("_last"))
    joined = placed.withColumn("_left", left).join(last, (F.col("user_id") == F.col("_user")) & F.col("start").eqNullSafe(F.col("_start")), "left")
    over = (F.col("_left") <= 0) | F.coalesce(place > F.col("_last"), F.lit(False))
    reason = F.when(F.col("plan_type") == "FREE", F.when(over, "limit reached").when(F.col("is_private"), "private repository"))
    return joined.select("scan_id", "user_id", "plan_type", "created_at", "start", "_used", reason.alias("reason"))


def plan_quota(requests: DataFrame, users: DataFrame, store: Store) -> DataFrame:
    """Use of the quota per user and period; -1 stands for no limit."""
    judged = judged_requests(requests, users, store)
    count = lambda cond: F.count(F.when(cond, 1))
    per = judged.groupBy("user_id", "plan_type", "start").agg(
        count(F.col("reason").isNull()).alias("accepted"), count(F.col("reason") == "limit reached").alias("over_limit"),
        count(F.col("reason") == "private repository").alias("private"), F.max("_used").alias("_used"),
    )
    used = F.col("accepted") + F.when(F.col("start").isNull(), F.col("_used")).otherwise(0)
    free = F.col("plan_type") == "FREE"
    return per.select(
        "user_id", "plan_type", F.col("start").alias("period_start"), used.alias("used"), F.when(free, FREE_SCANS).otherwise(-1).alias("scan_limit"),
        F.when(free, F.greatest(F.lit(0), FREE_SCANS - used)).otherwise(-1).alias("remaining"), "over_limit", "private",
    )


def quota_rejections(requests: DataFrame, users: DataFrame, store: Store) -> DataFrame:
    rejected = judged_requests(requests, users, store).filter("reason is not null")
    return rejected.select("user_id", F.col("start").alias("period_start"), "scan_id", "reason")
