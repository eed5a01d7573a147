"""Period training against a replay bout by bout in plain Python."""

import hashlib
import math
import statistics
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from boutlens import constants as K
from boutlens.catalog.evaluate import fixed_model
from boutlens.operators import models as M
from boutlens.plans import flows, periods, training

SIZE, WINDOW, OLDER, EPOCHS, SEED = 15, 40, 6, 12, 7


def draw(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16)


def fit(rows, w, b):
    """rows: (features, label, sample weight).  The descent in nested loops."""
    cols = list(zip(*(x for x, _, _ in rows), strict=True))
    mean, std = [statistics.fmean(c) for c in cols], [max(statistics.pstdev(c), 1e-8) for c in cols]
    z = [[v if j in K.UNSCALED else (v - mean[j]) / std[j] for j, v in enumerate(x)] for x, _, _ in rows]
    w = list(w)
    for e in range(EPOCHS):
        err = [(1 / (1 + math.exp(-max(-500, min(500, sum(a * c for a, c in zip(x, w, strict=True)) + b)))) - y) * s for x, (_, y, s) in zip(z, rows, strict=True)]
        for j in range(K.WIDTH):
            if int(hashlib.md5(f"{SEED}|{e}|{j}".encode()).hexdigest()[:8], 16) / 2**32 > (K.ENRICHED_DROPOUT if j in K.ENRICHED else K.BASE_DROPOUT):
                g = sum(x[j] * d for x, d in zip(z, err, strict=True)) / len(rows)
                if j in K.NO_DECAY:
                    w[j] -= K.LEARNING_RATE * g
                else:
                    w[j] -= K.LEARNING_RATE * (g + K.ALPHA * (1 - K.L1_RATIO) * w[j])
                    if abs(w[j]) < K.DEAD_ZONE:
                        w[j] = K.DEAD_ZONE if w[j] >= 0 else -K.DEAD_ZONE
            if j in K.POSITIVE_ONLY:
                w[j] = max(w[j], K.POSITIVE_FLOOR)
        w[10] = max(w[10], -K.NAMED_LIMITS[10])
        w[32] = max(-K.NAMED_LIMITS[32], min(K.NAMED_LIMITS[32], w[32]))
        b -= K.LEARNING_RATE * sum(err) / len(rows)
    return w, b


@pytest.fixture(scope="module")
def bouts(spark, sf):
    return flows.bout_features(spark, sf)


def test_accuracies_per_batch_equal_a_replay(spark, sf, bouts):
    model = fixed_model(spark, sf)
    stored = model.first()
    period = F.date_format("bout_date", "yyyy")
    first = bouts.agg(F.min(F.year("bout_date"))).first()[0]
    few = bouts.filter(F.year("bout_date") <= first + 1).filter("bout_id % 7 = 0")
    rows, models = periods.train_periods(few, model, period, SIZE, WINDOW, OLDER, EPOCHS, SEED)
    got = {(r.period, r.batch): (r.n, r.hits) for r in rows.groupBy("period", "batch").agg(
        F.count("*").alias("n"), F.count_if((F.col("proba_a") > 0.5) == (F.col("winner_side") == "a")).alias("hits")).collect()}
    table = {(r.period, r.batch): r for r in models.collect()}

    everything = sorted(few.select("bout_id", "bout_date", "winner_side", "blind_pick", "blind_conf", *K.FEATURE_NAMES).collect(), key=lambda r: (r.bout_date, r.bout_id))
    feature = lambda r: [float(r[n]) for n in K.FEATURE_NAMES]
    label = lambda r: int(r.winner_side == "a")
    factor = lambda r: 1.0 if r.blind_pick is None or min(85, max(60, r.blind_conf)) < 70 else 1 + (min(85, max(60, r.blind_conf)) - 70) / 50
    want, steps = {}, 0
    for year in sorted({str(r.bout_date.year) for r in everything}):
        own = [i for i, r in enumerate(everything) if str(r.bout_date.year) == year]
        w, b = list(stored.weights), stored.bias
        for k in range(-(-len(own) // SIZE)):
            assert list(table[year, k].weights) == pytest.approx(w, abs=1e-9) and table[year, k].bias == pytest.approx(b, abs=1e-9)
            batch = own[k * SIZE : (k + 1) * SIZE]
            score = lambda r: b + sum((v if j in K.UNSCALED else (v - stored.means[j]) / (stored.stds[j] if stored.stds[j] > 1e-12 else 1)) * w[j] for j, v in enumerate(feature(r)))  # noqa: E731, B023
            want[year, k] = len(batch), sum((score(everything[i]) > 0) == (everything[i].winner_side == "a") for i in batch if everything[i].winner_side is not None)
            if len(batch) == SIZE:
                h = own[0] + SIZE * (k + 1) - WINDOW
                old = sorted(range(1, h + 1), key=lambda i: (draw(f"{SEED}|{year}|{k}|{i}"), i))[:OLDER]
                fresh = [(feature(everything[i]), label(everything[i]), K.FRESH_WEIGHT * factor(everything[i])) for i in batch]
                new_w, new_b = fit(fresh + [(feature(everything[i - 1]), label(everything[i - 1]), K.HISTORICAL_WEIGHT * factor(everything[i - 1])) for i in old], w, b)
                one = spark.createDataFrame([(list(w), list(stored.stds), new_w, new_b)], "weights array<double>, stds array<double>, new_weights array<double>, new_bias double")
                after = M.update_weights(one).first()
                w, b, steps = list(after.updated), after.updated_bias, steps + 1
    assert got == want and steps >= 3


def test_draws_are_distinct_and_before_the_window(spark):
    starts = spark.createDataFrame([("p", 5000, 450), ("q", 100, 460), ("r", 1, 149)], "period string, start long, n long")
    got = periods.older_rows(starts, 150, 300, 60, 1).groupBy("period", "batch").agg(F.count("*").alias("n"), F.countDistinct("seq").alias("d"), F.min("seq").alias("lo"), F.max("seq").alias("hi")).collect()
    seen = {(r.period, r.batch): r for r in got}
    assert set(seen) == {("p", 0), ("p", 1), ("p", 2), ("q", 1), ("q", 2)}
    for (p, k), r in seen.items():
        h = (5000 if p == "p" else 100) - 1 + 150 * (k + 1) - 300
        assert r.n == r.d == min(60, h) and r.lo >= 1 and r.hi <= h


def test_draws_of_many_batches_take_no_longer_than_their_hashes(spark):
    """Each of 1680 batches draws from a long history: the positions of plain Python, in a few seconds."""
    starts = spark.createDataFrame([(f"p{p}", 10_000 + 3000 * p, 3000 + p) for p in range(84)], "period string, start long, n long")
    begun, got = time.time(), {}
    for r in periods.older_rows(starts, 150, 300, 60, SEED).collect():
        got.setdefault((r.period, r.batch), set()).add(r.seq)
    assert time.time() - begun < 60 and len(got) == 84 * 20
    for p, k in ((0, 0), (41, 7), (83, 19)):
        h = 10_000 + 3000 * p - 1 + 150 * (k + 1) - 300
        want = [draw(f"{SEED}|p{p}|{k}|{i}") % h + 1 for i in range(240)]
        assert got[f"p{p}", k] == set(list(dict.fromkeys(want))[:60])


def test_no_rows_and_no_full_batch(spark, sf, bouts):
    model = fixed_model(spark, sf)
    for rows in (bouts.limit(0), bouts.orderBy("bout_id").limit(3)):
        scored, models = periods.train_periods(rows, model, size=50)
        assert scored.count() == rows.count() and all(r.batch == 0 for r in models.collect())


def test_one_cycle_of_several_models(spark, sf, bouts):
    one = fixed_model(spark, sf)
    two = one.unionByName(one.withColumns({"model_id": F.lit(1), "bias": F.lit(0.3)}))
    out = {r.model_id: r for r in training.train_incremental(bouts, bouts.filter("held_out = 1"), two, 100, 0.0, epochs=50).collect()}
    assert out[0].status == "trained" and out[0].promoted and len(out[0].train_accuracy) == 1 and out[0].bias != out[1].bias
    none = training.train_incremental(bouts.limit(5), bouts.limit(0), one, 100, 0.0).first()
    assert none.status == "too few bouts" and not none.promoted and list(none.weights) == list(one.first().weights) and none.accuracy == pytest.approx(none.accuracy)


def test_settled_equals_update_weights(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(60):
        old, new = rng.normal(0, 0.2, K.WIDTH), rng.normal(0, 0.4, K.WIDTH)
        if k % 3 == 0:
            new[rng.integers(K.WIDTH, size=4)] = [np.nan, np.inf, -np.inf, 0.0]
        if k % 5 == 0:
            old[rng.integers(K.WIDTH, size=2)] = [np.nan, 0.0]
        rows.append((k, old.tolist(), np.where(rng.random(K.WIDTH) < 0.2, 0.0, rng.random(K.WIDTH)).tolist(), new.tolist(), [0.01, 0.2, 0.4, float("nan")][k % 4]))
    df = spark.createDataFrame(rows, "k int, weights array<double>, stds array<double>, new_weights array<double>, new_bias double")
    for r in M.update_weights(df).collect():
        w, b = M.settled(*(np.array(rows[r.k][i], float) for i in (1, 3, 2)), rows[r.k][4])
        assert np.allclose(w, np.array(r.updated), atol=1e-12, equal_nan=True) and b == r.updated_bias


def test_a_chain_over_cut_parts(spark):
    """A batch that is spread over parts of the input is one batch, and chains don't touch."""
    rng = np.random.default_rng(5)
    rows = pd.DataFrame(rng.random((600, K.WIDTH)), columns=K.FEATURE_NAMES)
    rows = rows.assign(period=["p"] * 400 + ["q"] * 200, batch=[i // 100 % 4 for i in range(600)], label=rng.integers(0, 2, 600), sample_weight=1.0)
    rows = rows.assign(weights=[[0.01] * K.WIDTH] * 600, stds=[[1.0] * K.WIDTH] * 600, bias=0.0)
    run = periods.chains(3, SEED)
    whole = pd.concat(run(iter([rows])))
    cut = pd.concat(run(rows.iloc[i:i + 37] for i in range(0, 600, 37)))
    assert whole[["period", "batch"]].values.tolist() == [["p", 1], ["p", 2], ["p", 3], ["p", 4], ["q", 1], ["q", 2]]
    assert whole.reset_index(drop=True).equals(cut.reset_index(drop=True))
