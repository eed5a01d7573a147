"""What is written can be read back; bounds that were once silent."""

import difflib
import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from boutlens import session
from boutlens.functions.text import norm_latin
from boutlens.operators import dataset as DS
from boutlens.operators import entities as EN
from boutlens.operators import ledger as L
from boutlens.operators import quality as QA
from boutlens.sources import datasets, feeds


def bout(a, b, day="2024-01-02"):
    return {"fighter_a": a, "fighter_b": b, "date": day, "winner": a, "stats_a": {"age": 30}, "stats_b": {}}


def test_pending_and_bouts_come_back(spark, tmp_path):
    (tmp_path / "in_part1.json").write_text(json.dumps([bout("A", "B"), bout("C", "D"), bout("A", "B")]))
    landed = datasets.read_pending(spark, f"{tmp_path}/in_part1.json")
    datasets.write_pending(landed, f"{tmp_path}/pending")
    again = datasets.read_pending(spark, f"{tmp_path}/pending")
    assert sorted(map(str, again.select("fight_key", "winner", "stats_a").collect())) == sorted(map(str, landed.select("fight_key", "winner", "stats_a").collect()))
    assert again.count() == 2
    rows = datasets.read_bouts(spark, f"{tmp_path}/in_part1.json")
    datasets.append_bouts(rows.drop("seq", "fight_key"), f"{tmp_path}/bouts")
    back = datasets.read_bouts(spark, f"{tmp_path}/bouts")
    assert sorted(r.fight_key for r in back.collect()) == sorted(r.fight_key for r in rows.collect())


def test_holdout_entities_and_weights_come_back(spark, tmp_path):
    (tmp_path / "h.json").write_text(json.dumps({"06.2024": ["A_B_2024-06-02", "C_D_2024-06-02"], "x": "no list"}))
    held = datasets.read_holdout(spark, f"{tmp_path}/h.json")
    datasets.write_holdout(held, f"{tmp_path}/holdout")
    assert sorted(datasets.read_holdout(spark, f"{tmp_path}/holdout").collect()) == sorted(held.collect())
    (tmp_path / "bad.json").write_text("not json")
    with pytest.raises(Exception, match="no holdout document"):
        datasets.read_holdout(spark, f"{tmp_path}/bad.json").collect()
    (tmp_path / "e.json").write_text(json.dumps({"F_1": {"normalized": "b", "aliases": ["B"]}, "F_0": {"normalized": "a", "aliases": ["A"]}}))
    ents = datasets.read_entities(spark, f"{tmp_path}/e.json")
    datasets.write_entities(ents, f"{tmp_path}/ents")
    assert sorted(map(str, datasets.read_entities(spark, f"{tmp_path}/ents").collect())) == sorted(map(str, ents.collect()))
    (tmp_path / "w.json").write_text(json.dumps({"weights": [0.1, 0.2], "bias": 0.5, "loocv_accuracy": 0.6}))
    weights = datasets.read_weights(spark, f"{tmp_path}/w.json")
    datasets.write_weights(weights, f"{tmp_path}/weights")
    back = datasets.read_weights(spark, f"{tmp_path}/weights").first()
    assert back.weights == [0.1, 0.2] and back.bias == 0.5 and back.accuracy == 0.6 and back.model_id == "w.json"


def test_feed_order_follows_files_and_places(spark, tmp_path):
    for name, teams in (("b.json", ["C", "D"]), ("a.json", ["A", "B" * 5000])):
        (tmp_path / name).write_text(json.dumps([{"home_team": t, "away_team": "x"} for t in teams]))
    got = feeds.read_odds_feed(spark, f"{tmp_path}/*.json").orderBy("feed_pos").collect()
    assert [r.home_team[0] for r in got] == ["A", "B", "C", "D"]


def test_stored_tables_follow_their_input(spark, tmp_path):
    path = f"{tmp_path}/t"
    spark.range(3).write.parquet(path)
    first = session.stored(spark, "t", lambda: spark.read.parquet(path))
    assert session.stored(spark, "t", lambda: spark.read.parquet(path)) is first
    spark.range(4).write.mode("append").parquet(path)
    assert session.stored(spark, "t", lambda: spark.read.parquet(path)).count() == 7


def test_all_pending_rows_are_fresh(spark):
    df = spark.range(900).select(F.col("id").alias("bout_id"), F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("bout_date"))
    for pending in (100, 400):
        strata = {r.stratum: r["count"] for r in DS.recent_split(df, pending).groupBy("stratum").count().collect()}
        assert strata["new"] == pending and sum(strata.values()) == 900
    assert DS.training_sample(df, 400).filter("is_fresh = 1").count() == 400


@pytest.mark.parametrize("k", [5, 120])
def test_ratio_candidates_equal_brute_force(spark, k):
    names = [f"{a}{b}son {c}" for a in ("Jo", "An", "Pet", "Mik") for b in ("na", "dre", "er", "ha", "el") for c in ("Smith", "Silva", "Ivanov", "Li", "Kim", "Costa", "Ng", "Park")]
    inputs = spark.createDataFrame([("Petrson Silvo",), ("Andreson Kim",)], "input string")
    pool = spark.createDataFrame([(n,) for n in names], "name string")
    got = EN.fuzzy_top(inputs, pool, k=k, method="ratio").collect()
    norm = {r.name: r.n for r in pool.select("name", norm_latin(F.col("name")).alias("n")).collect()}
    for asked, target in ((r.input, r.n) for r in inputs.select("input", norm_latin(F.col("input")).alias("n")).collect()):
        want = sorted((-difflib.SequenceMatcher(None, target, norm[n]).ratio(), n) for n in names)[:k]
        assert [(r.name) for r in sorted(got, key=lambda r: r.rank) if r.input == asked] == [n for _, n in want]


def test_drift_looks_at_every_row(spark):
    df = spark.createDataFrame([({"age": "1", "odd": "2"} if i == 90 else {"age": "1"}, i) for i in range(100)], "stats_a map<string,string>, pos int")
    got = {r.key: (r.n, r.level) for r in QA.drift(df).collect()}
    assert got["odd"] == (1, "unexpected") and got["age"] == (0, "ok") and got["name"] == (100, "many") and "odd" not in {r.key for r in QA.drift(df, head=50).collect()}


def test_signature_equals_the_standard_library(spark):
    for secret in ("s", "k" * 80):
        got = spark.createDataFrame([("dev1:20300101",), ("é",), ("",)], "p string").select("p", L.signature(secret)(F.col("p")).alias("s")).collect()
        assert all(r.s == hmac.new(secret.encode(), r.p.encode(), hashlib.sha256).hexdigest()[:16] for r in got)


def test_activation_never_goes_below_zero_and_large_steps_stop_no_job(spark):
    rows = [("u", "2024-01-01 00:00:00", 0, 0, True)] + [("u", f"2024-01-01 0{i}:00:00", i, -1, False) for i in range(1, 7)] + [("u", "2024-01-01 09:00:00", 9, 2, False)]
    df = spark.createDataFrame(rows, "user_id string, t string, event_id int, delta int, s boolean").withColumn("ts", F.to_timestamp("t"))
    assert L.activations(df, "user_id", F.col("s"), 3).first().balance == 2
    walked = L.running_balance(df.withColumn("delta", F.lit(-2)), start=3).orderBy("ts").collect()
    assert [r.balance for r in walked] == [1, 0, 0, 0, 0, 0, 0, 0] and walked[-1].plain == 3 - 16


def test_tables_are_stored_by_tasks_of_bounded_size(spark, monkeypatch):
    from boutlens import session

    seen = []
    monkeypatch.setattr(session, "materialize", lambda df, label: seen.append({k: session._bytes(spark.conf.get(k)) for k in session.BOUNDS}) or df)
    kept = {k: spark.conf.get(k) for k in session.BOUNDS}
    try:
        for given, inside in (("64MB", 16 << 20), ("4m", 4 << 20)):
            for k in session.BOUNDS:
                spark.conf.set(k, given)
            session.stored(spark, f"bounded-{given}", lambda: spark.range(3))
            assert seen.pop() == dict.fromkeys(session.BOUNDS, inside) and all(spark.conf.get(k) == given for k in session.BOUNDS)
    finally:
        session.forget()
        for k, v in kept.items():
            spark.conf.set(k, v)
