"""Quota periods against a plain loop over requests."""

import datetime as dt
import random

import pytest

from sievebase.operators import quota
from sievebase.plans.scan import materialize


def month_later(at):
    year, month = at.year + at.month // 12, at.month % 12 + 1
    last = (dt.date(year + month // 12, month % 12 + 1, 1) - dt.timedelta(days=1)).day
    return at.replace(year=year, month=month, day=min(at.day, last))


def plain(requests, users):
    state = {u[0]: [u[2], u[3] or 0, None] for u in users}
    plans = {u[0]: u[1] for u in users}
    out = []
    for scan, user, at, private in sorted(requests, key=lambda r: (r[2], r[0])):
        if user not in state:
            continue
        until, used, start = state[user]
        if until is None or until <= at:
            until, used, start = month_later(at), 0, at
        reason = None
        if plans[user] == "FREE":
            reason = "limit reached" if used >= 3 else "private repository" if private else None
        state[user] = [until, used + (reason is None), start]
        out.append((scan, user, start, reason))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_periods_equal_a_plain_loop(spark, seed):
    rnd = random.Random(seed)
    begin = dt.datetime(2023, 1, 29)
    users = [(u, rnd.choice(["FREE", "FREE", "PRO"]), rnd.choice([None, begin + dt.timedelta(days=rnd.randrange(90))]), rnd.choice([None, 0, 2, 7])) for u in range(12)]
    users[0] = (0, "FREE", None, None)
    requests = []
    for k in range(900):
        user = 0 if k < 400 else rnd.randrange(14)  # one user with very many, some unknown ones
        requests.append((k, user, begin + dt.timedelta(hours=12 * rnd.randrange(1200)), rnd.random() < 0.3))
    tables = (
        spark.createDataFrame(requests, "scan_id long, user_id long, created_at timestamp_ntz, is_private boolean").repartition(3),
        spark.createDataFrame(users, "user_id long, plan_type string, reset_date timestamp_ntz, scans_this_month int"),
    )
    want = plain(requests, users)
    got = quota.judged_requests(*tables, materialize).select("scan_id", "user_id", "start", "reason").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert {r.reason for r in got} == {None, "limit reached", "private repository"} and any(r.start is None for r in got)


def test_no_requests(spark):
    requests = spark.createDataFrame([], "scan_id long, user_id long, created_at timestamp_ntz, is_private boolean")
    users = spark.createDataFrame([(1, "FREE", None, None)], "user_id long, plan_type string, reset_date timestamp_ntz, scans_this_month int")
    assert quota.plan_quota(requests, users, materialize).count() == 0
