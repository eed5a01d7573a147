"""Totals, sessions and matches over sorted ranges, with keys that hold a third of all rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from boutlens.operators import ledger as L
from boutlens.operators.ranges import in_order, running

T0 = dt.datetime(2024, 1, 1)
PARTS = 16


@pytest.fixture
def many(spark):
    """More ranges than a test session has by default."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", str(PARTS))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def rows(n=2400, seed=1):
    rng = random.Random(seed)
    return [(None if i % 97 == 0 else 7 if i % 3 == 0 else rng.randrange(60), T0 + dt.timedelta(seconds=rng.randrange(400_000)), i, rng.choice([-2, -1, -1, 3])) for i in range(n)]


def by_user(data):
    out = {}
    for r in sorted(data, key=lambda r: (r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


def test_totals_over_edges_of_ranges(spark, many):
    data = rows()
    df = in_order(spark.createDataFrame(data, "user_id long, ts timestamp, event_id long, delta long").repartition(7), ["user_id"], ["ts", "event_id"], "t")
    totals = {"s": ("sum", F.col("delta")), "low": ("min", F.col("delta")), "last": ("max", F.when(F.col("delta") > 0, F.struct("_row", "event_id")))}
    for inclusive in (True, False):
        got = {r.event_id: (r.s, r.low, r["last"] and r["last"].event_id) for r in running(df, ["user_id"], totals, inclusive).collect()}
        want = {}
        for mine in by_user(data).values():
            for k, r in enumerate(mine):
                seen = mine[: k + inclusive]
                ups = [x[2] for x in seen if x[3] > 0]
                want[r[2]] = (sum(x[3] for x in seen) if seen else None, min((x[3] for x in seen), default=None), ups[-1] if ups else None)
        assert got == want


def test_a_hot_key_is_spread_over_ranges(spark, many):
    data = rows(6000)
    df = in_order(spark.createDataFrame(data, "user_id long, ts timestamp, event_id long, delta long").repartition(7), ["user_id"], ["ts", "event_id"], "t")
    largest = df.groupBy("user_id", "_part").count().agg(F.max("count")).first()[0]
    assert sum(r[0] == 7 for r in data) > 1900 and largest <= 3 * len(data) / PARTS


def test_sessions_of_a_hot_user(spark, many):
    data = rows()
    got = sorted(((r.user_id, r.start, r.end, r.n) for r in L.sessions(spark.createDataFrame(data, "user_id long, ts timestamp, event_id long, delta long"), gap=900).collect()), key=repr)
    want = []
    for user, mine in by_user(data).items():
        now = [mine[0][1], mine[0][1], 0]
        for r in mine:
            if (r[1] - now[1]).total_seconds() > 900:
                want.append((user, *now))
                now = [r[1], r[1], 0]
            now[1:] = [r[1], now[2] + 1]
        want.append((user, *now))
    assert got == sorted(want, key=repr) and len(want) > 200


def test_payments_of_a_hot_amount(spark, many):
    rng = random.Random(9)
    data = [(i, T0 + dt.timedelta(seconds=rng.randrange(60_000)), 10 if i % 3 else rng.randrange(11, 16), rng.random() < 0.5) for i in range(1500)]
    df = spark.createDataFrame(data, "event_id long, ts timestamp, amount int, paid boolean")
    got = {(r.reservation_id, r.receipt_id) for r in L.match_payments(df.filter("paid"), df.filter("NOT paid")).collect()}
    first = {}
    for i, ts, amount, paid in sorted(data, key=lambda r: (r[1], r[0])):
        if paid:
            fits = [(t, j) for j, t, a, p in data if not p and a == amount and t <= ts <= t + dt.timedelta(seconds=900)]
            if fits:
                first.setdefault(min(fits)[1], i)
    assert got == set(first.items()) and len(got) > 100


def test_no_rows(spark):
    none = spark.createDataFrame([], "user_id long, ts timestamp, event_id long, delta long")
    assert L.sessions(none).collect() == [] and L.running_balance(none).collect() == [] and L.previous_time(none, "user_id").collect() == []
