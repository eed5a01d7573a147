"""Keyed streams in event time: shuffled micro-batches against the batch forms."""

import datetime as dt
import random

import pytest

from boutlens.operators import accounts as A
from boutlens.streaming import ordered
from tests.test_accounts import SCHEMA, T0, history, replay

END = T0 + dt.timedelta(days=4000)


@pytest.fixture(scope="module", autouse=True)
def store(spark):
    ordered.use_rocksdb(spark)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def batches(spark, rows, schema, path, pieces, blur):
    """A file per micro-batch; rows are out of order by up to ``blur``, also across files."""
    rng = random.Random(3)
    at = schema.split(", ").index("ts timestamp")
    rows = sorted(rows, key=lambda r: r[at] + blur * rng.random())
    size = -(-len(rows) // pieces)
    for k in range(0, len(rows), size):
        spark.createDataFrame(rows[k : k + size], schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def run(df, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"cp_{name}")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    state = q.lastProgress["stateOperators"][0] if q.lastProgress["stateOperators"] else {}
    return [tuple(r) for r in df.sparkSession.table(name).collect()], state


def greedy(rows, seconds):
    """Receipts in order, each with the earliest reservation still open."""
    out, open_ = [], {}
    for event_id, ts, amount, is_receipt in sorted(rows, key=lambda r: (r[1], r[0])):
        mine = open_.setdefault(amount, [])
        if not is_receipt:
            mine.append((ts, event_id))
            continue
        mine[:] = [x for x in mine if x[0] >= ts - dt.timedelta(seconds=seconds)]
        if mine:
            out.append((amount, mine.pop(0)[1], event_id, ts))
    return out


def test_no_reservation_is_paid_twice(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, T0 + dt.timedelta(seconds=20 * i + rng.randrange(300)), rng.choice([10, 10, 10, 11, 12]), rng.random() < 0.5) for i in range(300)]
    flush = [(1000, END, 99, False)]
    schema = "event_id long, ts timestamp, amount int, is_receipt boolean"
    src = batches(spark, [*rows, *flush], schema, tmp_path / "p", 6, dt.timedelta(minutes=20))
    got, state = run(ordered.match_payments(src.filter("is_receipt"), src.filter("NOT is_receipt")), "paid", tmp_path)
    assert sorted(got) == sorted(greedy(rows, 900)) and len(got) > 50
    assert len({r[1] for r in got}) == len({r[2] for r in got}) == len(got)
    # only the row that moved the watermark still waits
    assert state["numRowsTotal"] <= 4


def test_limiter_in_event_order(spark, tmp_path):
    rng = random.Random(5)
    rows = [(u, T0 + dt.timedelta(hours=rng.randrange(400), seconds=i), i, u == 3) for i, u in enumerate(rng.choices(range(4), k=120))]
    src = batches(spark, [*rows, (9, END, 1000, False)], "user_id long, ts timestamp, event_id long, is_pro boolean", tmp_path / "l", 5, dt.timedelta(hours=30))
    got, _ = run(ordered.limit_training(src, late="40 hours"), "limited", tmp_path)
    want, last = set(), {}
    for u, ts, i, pro in sorted(rows, key=lambda r: (r[1], r[2])):
        fine = pro or u not in last or ts - last[u] >= dt.timedelta(hours=24)
        if fine and not pro:
            last[u] = ts
        want.add((u, i, int(fine)))
    assert set(got) == want and {w[2] for w in want} == {0, 1}


def test_accounts_equal_the_batch_walk(spark, tmp_path):
    rows = [r for r in history(8, 240, 6) if r[0] is not None]
    src = batches(spark, [*rows, (99, END, 5000, "debit", 1, None, None)], SCHEMA, tmp_path / "a", 5, dt.timedelta(hours=10))
    got, _ = run(ordered.accounts(src, late="20 hours"), "accounts", tmp_path)
    want = {i: (s, b, p, a) for i, (s, b, p, _, a) in replay(rows).items()}
    assert {r[1]: r[2:] for r in got} == want
    batch = A.walk(spark.createDataFrame(rows, SCHEMA))
    assert {r.event_id: (r.status, r.balance, r.plan, r.is_active) for r in batch.collect()} == want
