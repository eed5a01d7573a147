"""Streams against their batch twins, from file sources."""

import datetime as dt

from pyspark.sql import functions as F

from boutlens.operators import ledger as L
from boutlens.streaming import jobs
from boutlens.streaming.trigger import CountTrigger

T0 = dt.datetime(2024, 1, 1)


def _stream(spark, df, path):
    df.write.mode("overwrite").parquet(str(path))
    return spark.readStream.schema(df.schema).parquet(str(path))


def _run(df, name, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp_{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_payment_join(spark, tmp_path):
    res = spark.createDataFrame([(1, T0, 10), (2, T0 + dt.timedelta(minutes=2), 10)], "event_id long, ts timestamp, amount int")
    rec = spark.createDataFrame([(7, T0 + dt.timedelta(minutes=10), 10), (8, T0 + dt.timedelta(minutes=40), 10)], "event_id long, ts timestamp, amount int")
    pairs = _run(jobs.match_payments(_stream(spark, rec, tmp_path / "a"), _stream(spark, res, tmp_path / "b")), "pay", tmp_path)
    got = {(r["reservation_id"], r["receipt_id"]) for r in jobs.first_match(pairs).collect()}
    assert got == {(r["reservation_id"], r["receipt_id"]) for r in L.match_payments(rec, res).collect()} == {(1, 7)}


def test_balances_equal_batch(spark, tmp_path):
    rows = [(i, T0 + dt.timedelta(minutes=i), i % 3, [3, -1, -1, -1, -1][i % 5], None) for i in range(90)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, delta int, expires_at timestamp")
    got = _run(jobs.balances(_stream(spark, df, tmp_path / "m"), start=2), "bal", tmp_path)
    want = L.running_balance(df.drop("expires_at"), start=2)
    assert {(r["event_id"], r["balance"]) for r in got.collect()} == {(r["event_id"], r["balance"]) for r in want.collect()}


def test_limiter_counts_from_last_allowed(spark, tmp_path):
    hours = [0, 13, 25, 30, 60]
    rows = [(i, T0 + dt.timedelta(hours=h), u, u == 2) for u in (1, 2) for i, h in enumerate(hours, u * 10)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, is_pro boolean")
    got = {r["event_id"]: r["allowed"] for r in _run(jobs.limit_training(_stream(spark, df, tmp_path / "l")), "lim", tmp_path).collect()}
    assert [got[10 + i] for i in range(5)] == [1, 0, 1, 0, 1] and all(got[20 + i] for i in range(5))


def test_progress_and_snapshots(spark, tmp_path):
    lines = ['{"type": "stage", "current": 1, "total": 3}', "log", "", '{"type": "stage", "current": 2, "total": 3}', '{"status": "success"}']
    df = spark.createDataFrame([("r", i, x) for i, x in enumerate(lines)], "run_id string, seq int, line string")
    got = _run(jobs.latest_progress(_stream(spark, df, tmp_path / "p")), "prog", tmp_path, "complete").collect()
    assert [(r["stage"], r["result"]) for r in got] == [("bout 2/3", "success")]
    snaps = spark.createDataFrame([("a", T0), ("a", T0 + dt.timedelta(minutes=5)), ("b", T0)], "k string, ts timestamp")
    assert _run(jobs.fresh_snapshots(_stream(spark, snaps, tmp_path / "s"), ["k"]), "snap", tmp_path).count() == 2


def test_count_trigger(spark, tmp_path):
    trained = []
    schema = "bout_id long"
    trigger = CountTrigger(spark, str(tmp_path / "buf"), lambda df, i: trained.append(df.count()), schema, size=150)
    src = tmp_path / "in"
    for k in range(4):
        spark.range(k * 60, k * 60 + 60).select(F.col("id").alias("bout_id")).coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    trigger.start(stream, str(tmp_path / "cp")).awaitTermination(120)
    assert trained == [180]
    assert trigger.status() == {"buffer_size": 60, "batch_size": 150, "is_training": True, "fights_remaining": 90}
    assert trigger.flush() == "buffered" and trigger.set_training(False) == "buffered"


def test_a_micro_batch_reads_no_earlier_folders(spark, tmp_path):
    trained = []
    trigger = CountTrigger(spark, str(tmp_path / "buf"), lambda df, i: trained.append((i, df.count(), len(df.inputFiles()))), "bout_id long", size=30)
    rows = lambda a, n: spark.range(a, a + n).select(F.col("id").alias("bout_id")).coalesce(1)
    seen = []
    for k in range(12):
        trigger.on_batch(rows(10 * k, 10), k)
        seen.append((len(trigger.pending().inputFiles()), len(trigger._lists())))
    assert trained == [(2, 30, 3), (5, 30, 3), (8, 30, 3), (11, 30, 3)]
    assert max(f for f, _ in seen) == 2 and max(n for _, n in seen) == 2
    # an empty micro-batch is not listed, and a replayed one counts once
    trigger.on_batch(rows(0, 0), 12)
    trigger.on_batch(rows(500, 20), 13)
    trigger.on_batch(rows(500, 20), 13)
    assert trigger.status()["buffer_size"] == 20 and sorted(r["bout_id"] for r in trigger.pending().collect()) == list(range(500, 520))
    trigger.on_batch(rows(600, 15), 14)
    assert trained[-1][:2] == (14, 35) and trigger.flush() == "empty"


def test_stream_windows_equal_the_batch_forms(spark, tmp_path):
    rows = [(i, T0 + dt.timedelta(minutes=7 * i), i % 3, "view" if i % 2 else "click", float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double")
    got = _run(jobs.tumbling(_stream(spark, df, tmp_path / "w")), "tumbling", tmp_path, "complete").collect()
    want = df.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("w.start", "event_type", "n", "total")
    assert {tuple(r) for r in got} == {tuple(r) for r in want.collect()} and got
    ended = _run(jobs.sessions(_stream(spark, df.filter("event_id % 10 < 3 OR user_id = 0"), tmp_path / "s2"), gap="30 minutes"), "sessions", tmp_path, "complete").collect()
    batch = L.sessions(df.filter("event_id % 10 < 3 OR user_id = 0"), gap=1799)
    assert {(r["user_id"], r["start"], r["n"]) for r in ended} == {(r["user_id"], r["start"], r["n"]) for r in batch.collect()} and ended
