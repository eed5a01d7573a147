"""Operators against brute force and hand-made cases."""

import datetime as dt
import json
import math
import random

from pyspark.sql import functions as F

from boutlens import constants as K
from boutlens.operators import evaluate as E
from boutlens.operators import dataset as DS
from boutlens.operators import entities as EN
from boutlens.operators import ledger as L
from boutlens.operators import models as M
from boutlens.operators import records as R
from boutlens.operators.history import global_position, point_in_time
from boutlens.sources import datasets, feeds

DAY0 = dt.date(1999, 1, 1)


def _sides(seed, n, hot=0.0, days=40):
    rng, rows = random.Random(seed), []
    for i in range(n):
        a, b = (0, 1 + rng.randrange(6)) if rng.random() < hot else rng.sample(range(7), 2)
        day, w = DAY0 + dt.timedelta(days=rng.randrange(days) * 11), rng.choice("ab-")
        fin = rng.random() < 0.5
        for flag, fid, me in ((1, a, "a"), (0, b, "b")):
            won = int(w == me)
            rows.append((i, day, flag, fid, won, int(w not in (me, "-")), int(won and fin), int(won and fin and i % 3 == 0)))
    return rows


def _brute(rows):
    out = {}
    for i, day, flag, fid, *_ in rows:
        past = sorted((r for r in rows if r[3] == fid and (r[1], r[0]) < (day, i)), key=lambda r: (r[1], r[0]))
        last = past[-5:]
        wins = sum(r[4] for r in past)
        out[i, fid] = (sum(r[4] for r in last), "".join("W" if r[4] else "L" if r[5] else "D" for r in last), wins, sum(r[5] for r in past),
                       (day - past[-1][1]).days if past else -1, sum(1 for r in past if 1 <= (day - r[1]).days <= 365),
                       sum(r[6] for r in past) / wins if wins else 0.5)
    return out


def test_history_matches_brute_force_at_any_block_size(spark):
    rows = _sides(3, 150, hot=0.4)
    df = spark.createDataFrame(rows, "bout_id long, bout_date date, is_a int, fid long, won int, lost int, fin int, sub int")
    want = _brute(rows)
    for bits in (1, 4, 20):
        got = {(r["bout_id"], r["fid"]): (r["recent_wins"], r["form"], r["wins"], r["losses"], r["days_off"], r["fights_12m"], r["fin_rate"])
               for r in point_in_time(df, bits).collect()}
        assert got == want


def test_history_plan_has_no_window_over_a_whole_competitor_of_rows(spark):
    df = spark.createDataFrame(_sides(1, 20), "bout_id long, bout_date date, is_a int, fid long, won int, lost int, fin int, sub int")
    plan = point_in_time(df)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_global_position(spark):
    rows = [(i, DAY0 + dt.timedelta(days=(i * 7) % 13)) for i in range(200)]
    df = spark.createDataFrame(rows, "bout_id long, bout_date date")
    want = {i: n for n, (d, i) in enumerate(sorted((d, i) for i, d in rows), 1)}
    for bits in (2, 20):
        assert {r["bout_id"]: r["seq"] for r in global_position(df, "bout_date", "bout_id", bits=bits).collect()} == want


def _bouts(spark, n):
    return spark.createDataFrame([(i, DAY0 + dt.timedelta(days=i)) for i in range(n)], "bout_id long, bout_date date")


def test_eval_slice_sizes(spark):
    assert DS.eval_slice(_bouts(spark, 300)).count() == 100
    got = [r["bout_id"] for r in DS.eval_slice(_bouts(spark, 150)).collect()]
    assert sorted(got) == list(range(0, 50))
    assert DS.eval_slice(_bouts(spark, 105)).count() == 100      # only 5 before the last 100: take those
    assert DS.eval_slice(_bouts(spark, 7)).count() == 7


def test_training_sample_is_the_same_on_any_partitioning(spark):
    df = _bouts(spark, 1000)
    one = sorted(r["bout_id"] for r in DS.training_sample(df.repartition(1), 100).collect())
    two = sorted(r["bout_id"] for r in DS.training_sample(df.repartition(7), 100).collect())
    assert one == two and len(one) == 100 + 39 + 60


def test_upsert_twice_is_once(spark):
    schema = "k string, id long, conf int"
    cur = spark.createDataFrame([("a", 1, 1), ("b", 2, 2)], schema)
    new = spark.createDataFrame([("b", 9, 7), ("c", 3, 3), ("c", 4, None)], schema)
    once = DS.upsert(cur, new, "k", ["id"], ["conf"])
    got = {r["k"]: (r["id"], r["conf"], r["change"]) for r in once.collect()}
    assert got == {"a": (1, 1, "kept"), "b": (2, 7, "refreshed"), "c": (3, None, "new")}
    again = DS.upsert(once.select("k", "id", "conf"), new, "k", ["id"], ["conf"])
    assert {(r["k"], r["id"], r["conf"]) for r in again.collect()} == {(k, v[0], v[1]) for k, v in got.items()}


def test_balance_closed_form(spark):
    rng = random.Random(5)
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randrange(9000)), 1 if rng.random() < .5 else rng.randrange(5), rng.choice([3, -1, -1, -1, 1])) for i in range(400)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, delta int")
    want, rejected = {}, {}
    for i, ts, u, d in sorted(rows, key=lambda r: (r[1], r[0])):
        b = want.get(u, 2)
        rejected[u] = rejected.get(u, 0) + (b + d < 0)
        want[u] = max(0, b + d)
    got = {r["user_id"]: (r["balance"], r["rejected"]) for r in L.final_balance(df, start=2).collect()}
    assert got == {u: (b, rejected[u]) for u, b in want.items()}


def test_payment_window_edges(spark):
    t = dt.datetime(2024, 1, 1, 12, 0, 0)
    res = spark.createDataFrame([(1, t, 10), (2, t + dt.timedelta(minutes=1), 10), (3, t, 20)], "event_id long, ts timestamp, amount int")
    rec = spark.createDataFrame([(7, t + dt.timedelta(minutes=15), 10), (8, t + dt.timedelta(minutes=15, seconds=1), 10), (9, t + dt.timedelta(minutes=15, seconds=1), 20)],
                                "event_id long, ts timestamp, amount int")
    got = {(r["reservation_id"], r["receipt_id"]) for r in L.match_payments(rec, res).collect()}
    assert got == {(1, 7), (2, 8)}


def test_answers(spark):
    full = {k: 1 for k in K.ANSWER_KEYS}
    raw = ["```json\n" + json.dumps(full) + "\n```", "text " + json.dumps(full) + " more", json.dumps({"age": 3}), "{broken", None]
    got = R.parse_answer(spark.createDataFrame([(r,) for r in raw], "raw string")).collect()
    assert [r["answer"] is not None for r in got] == [True, True, False, False, False]
    assert len(got[2]["missing_keys"]) == 19


def _bundle(spark, old, new, stds=None, bias=0.01):
    return spark.createDataFrame([(1, old, stds or [1.0] * 46, new, bias)], "model_id int, weights array<double>, stds array<double>, new_weights array<double>, new_bias double")


def test_update_guards(spark):
    nan = float("nan")
    old, new = [0.2] * 46, [0.2] * 46
    old[17], old[10], old[3], old[5], old[8], old[9] = 0.5, -0.5, -1.0, 0.5, 0.0, nan
    old[44], old[45] = 0.4, -0.2
    old[20] = 3.0
    new[44], new[45], new[20], new[9] = 0.4, -0.2, 3.0, 0.07
    row = M.update_weights(_bundle(spark, old, new, bias=0.2)).first()
    w = row["updated"]
    assert row["updated_bias"] == 0.05
    assert w[17] == 0.04 and w[10] == -0.06 and w[3] == 0.002 and w[5] == 0.1
    assert abs(w[8] - 0.1) < 1e-12                     # half step from 0 to 0.2
    assert w[9] == 0.07                                # NaN repaired from the new weights
    assert math.isclose(w[44], 0.1) and math.isclose(w[45], -0.05)   # both out: one factor
    assert w[20] == 0.4                                # clipped by spread to 0.5, then by its pair


def test_pair_limits_leave_no_violation(spark):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-2, 2) for _ in range(46)]) for i in range(50)]
    df = spark.createDataFrame(rows, "model_id int, weights array<double>")
    fixed = df.withColumn("weights", M.constrain_pairs("weights"))
    assert M.pair_rows(fixed).filter("in_bounds = 0 AND greatest(abs(w1), abs(w2)) > bound + 0.0001").count() == 0


def test_canonical_alias(spark):
    rows = [(["Sean", "Шон", "Шон О'Мэлли"],), (["Sean", "The Шон'", "Шон"],), (["Sean"],), ([],)]
    got = [r["x"] for r in spark.createDataFrame(rows, "a array<string>").select(EN.canonical_alias(F.col("a")).alias("x")).collect()]
    assert got == ["Шон О'Мэлли", "The Шон'", "Sean", None]


def test_parts_keep_numeric_order_and_skip_bad_files(spark, tmp_path):
    def bout(a, b):
        return {"fighter_a": a, "fighter_b": b, "date": "2024-01-02", "winner": a, "stats_a": {"age": 30, "extra": 1}, "stats_b": {}}
    (tmp_path / "x_part10.json").write_text(json.dumps([bout("C", "D")]))
    (tmp_path / "x_part2.json").write_text(json.dumps([bout("A", "B"), bout("B", "A")]))
    (tmp_path / "x_part3.json").write_text('{"not": "a list"}')
    df = datasets.read_parts(spark, f"{tmp_path}/x_part*.json")
    assert [r["fight_key"] for r in df.orderBy("seq").collect()] == ["A_B_2024-01-02", "B_A_2024-01-02", "C_D_2024-01-02"]
    assert datasets.read_parts(spark, f"{tmp_path}/x_part2.json", stats_as_map=True).first()["stats_a"] == {"age": "30", "extra": "1"}
    out = f"{tmp_path}/table"
    datasets.append_bouts(df, out)
    datasets.append_bouts(df, out)
    assert spark.read.parquet(out).count() == 6
    assert datasets.read_pending(spark, f"{tmp_path}/x_part2.json").count() == 2


def test_small_documents(spark, tmp_path):
    (tmp_path / "h.json").write_text(json.dumps({"06.2024": ["A_B_2024-06-02", "C_D_2024-06-02"], "x": "not a list", "07.2024": []}))
    assert datasets.read_holdout(spark, f"{tmp_path}/h.json").count() == 2
    (tmp_path / "t.json").write_text(json.dumps({"tariffs": {"500": {"predictions": 100, "days": 60}}, "other": ""}))
    assert datasets.read_tariffs(spark, f"{tmp_path}/t.json").collect()[0] == (500, 100, 60)
    (tmp_path / "e.json").write_text(json.dumps({"F_1": {"normalized": "b", "aliases": ["B"], "fights_count": 1}, "F_0": {"normalized": "a", "aliases": ["A", "Я"]}}))
    ents = datasets.read_entities(spark, f"{tmp_path}/e.json").orderBy("pos").collect()
    assert [e["entity_id"] for e in ents] == ["F_1", "F_0"] and ents[1]["aliases"] == ["A", "Я"]
    (tmp_path / "w.json").write_text(json.dumps({" weights": [0.1, 0.2], "bias ": 0.5, "feature_means": [1.0], "loocv_accuracy": 0.6}))
    w = datasets.read_weights(spark, f"{tmp_path}/w.json").first()
    assert w["weights"] == [0.1, 0.2] and w["bias"] == 0.5 and w["accuracy"] == 0.6
    lines = spark.createDataFrame([("2024-01-01T00:00:00 | sender=bank | Поступление | 5р",)], "value string")
    assert datasets.payment_log(lines).first()["text"] == "Поступление | 5р"


def test_scoreboard(spark, tmp_path):
    def side(name, won=None, cards=()):
        return {"athlete": {"fullName": name, "dateOfBirth": "1990-01-01"}, "winner": won, "linescores": [{"linescores": [{"displayValue": c} for c in cards]}] if cards else []}
    comp = {"competitors": [side("A", True, ["29", "28", "29"]), side("B", False, ["28", "29", "28"])], "status": {"type": {"name": "STATUS_FINAL", "state": "post"}, "period": 2},
            "format": {"regulation": {"periods": 5}}, "featured": True, "details": [{"type": {"text": "Decision"}}]}
    planned = {"competitors": [side("C"), side("D")], "status": {"type": {"name": "STATUS_SCHEDULED", "state": "pre"}}}
    feed = {"events": [{"name": "E", "date": "2024-01-13T02:00Z", "competitions": [comp, planned, {"competitors": [side("X")]}]}]}
    (tmp_path / "s.json").write_text(json.dumps(feed))
    rows = feeds.scoreboard_bouts(feeds.read_scoreboard(spark, f"{tmp_path}/s.json")).orderBy("fighter_a").collect()
    assert [(r["fighter_a"], r["winner"], r["method"], r["rounds"], r["round"]) for r in rows] == [("A", "A", "SD", 5, 2), ("C", None, "TBD", 3, 3)]


def test_odds_feed(spark, tmp_path):
    events = [{"home_team": "A", "away_team": "B", "bookmakers": [{"title": "Book", "markets": [{"outcomes": [{"name": "A", "price": 1.5}, {"name": "A", "price": 1.6}]}]}]},
              {"home_team": "C", "away_team": "D", "bookmakers": []}, {"home_team": "E", "away_team": "F", "bookmakers": [{"title": "Book", "markets": []}]}]
    (tmp_path / "o.json").write_text(json.dumps(events))
    got = feeds.odds_rows(feeds.read_odds_feed(spark, f"{tmp_path}/o.json")).orderBy("home_team").collect()
    assert [(r["bookmaker"], r["home_odds"], r["away_odds"]) for r in got] == [("Book", 1.6, 1.85), ("no data", 1.85, 1.85), ("Book", 1.85, 1.85)]


def test_key_violations_skip_missing_values(spark):
    from boutlens.operators import quality as QA
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), (None, 3), ("b", 4)], "device string, user long")
    got = {tuple(r) for r in QA.key_violations([("users", df, "device"), ("licenses", df, "user"), ("none", df.limit(0), "user")]).collect()}
    assert got == {("users", "device", "a", 2), ("licenses", "user", "3", 2)}


def test_wrong_predictions_are_filtered_after_the_score_is_worked_out_once(spark):
    """The score is in the plan once, whatever the filter asks of the prediction; undecided and unpredicted bouts are left out."""
    rows = [(1, 0.3, "b"), (2, 0.3, "a"), (3, None, "a"), (4, -0.3, "a"), (5, -0.3, None), (6, -0.3, "b")]
    df = spark.createDataFrame(rows, "bout_id long, x double, winner string").selectExpr("*", "DATE'2001-02-03' AS bout_date", "'a' AS fighter_a", "'b' AS fighter_b", "1 / (1 + exp(-x)) AS p")
    df = df.selectExpr("*", "CASE WHEN p > 0.9 THEN 0.9 WHEN p < 0.1 THEN 0.1 ELSE p END AS q").selectExpr("*", "CASE WHEN q > 0.5 THEN 'a' WHEN q <= 0.5 THEN 'b' END AS pred_winner")
    out = E.wrong_predictions(df)
    assert sorted(map(tuple, out.select("bout_id", "predicted", "fact").collect())) == [(1, "a", "b"), (4, "b", "a")]
    assert out.columns == ["bout_id", "bout_date", "fighter_a", "fighter_b", "predicted", "fact"]
    assert out._jdf.queryExecution().optimizedPlan().toString().upper().count("EXP(") == 1
