"""Incremental training: batch, gradient, full fit, guarded update, acceptance."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boutlens import constants as K
from boutlens.functions.numbers import camp_score, confidence_factor
from boutlens.operators import dataset as DS
from boutlens.operators import features as X
from boutlens.operators import models as M
from boutlens.operators import records as R
from boutlens.operators import scoring as S
from boutlens.session import materialize


def imputed(sample: DataFrame, enrich: R.Enrich) -> DataFrame:
    """Bouts whose sides have their gaps filled as of the day before, with ``filled`` per side, and the features of these sides."""
    fields = [f.name for f in sample.schema["stats_a"].dataType.fields]
    side = lambda flag, c: F.struct(F.lit(flag).alias("is_a"), F.col(c).alias("s"))
    sides = sample.select("bout_id", "bout_date", F.inline(F.array(side(1, "stats_a"), side(0, "stats_b")))).select("bout_id", "bout_date", "is_a", "s.*")
    sides = R.impute_rows(sides, enrich)
    if "camp_score" in fields:
        sides = sides.withColumn("camp_score", F.when(F.array_contains("filled", "camp_name"), camp_score(F.col("camp_name"))).otherwise(F.col("camp_score")))
    paired = X.pair_sides(sides, [*fields, "filled", "filled_as_of"], ["bout_date"]).select("bout_id", "stats_a", "stats_b")
    rest = sample.drop("stats_a", "stats_b", *K.FEATURE_NAMES)
    return rest.join(paired, "bout_id").select("*", *X.feature_columns(F.col("stats_a"), F.col("stats_b")))


def rows_of(drawn: DataFrame, features: DataFrame) -> DataFrame:
    """``drawn`` (bout_id, bout_date, others) with all columns of ``features``; of rows with one key, as many as were drawn."""
    order = Window.partitionBy("bout_id", "bout_date").orderBy("fight_key", "priority") if "priority" in features.columns else Window.partitionBy("bout_id", "bout_date").orderBy("fight_key")
    found = features.join(drawn.select("bout_id").distinct(), "bout_id", "left_semi").withColumn("_n", F.row_number().over(order))
    # a repeated key is in ``drawn`` once for each of its rows and each place from the end
    again = Window.partitionBy("bout_id", "bout_date", "from_end").orderBy("stratum")
    wanted = drawn.withColumn("_n", F.row_number().over(again)).select("_n", *[F.col(c).alias(f"_d_{c}") for c in drawn.columns])
    same = (F.col("bout_id") == F.col("_d_bout_id")) & F.col("bout_date").eqNullSafe(F.col("_d_bout_date")) & (found["_n"] == wanted["_n"])
    rest = [c for c in drawn.columns if c not in ("bout_id", "bout_date")]
    return found.join(wanted, same).select(*features.columns, *[F.col(f"_d_{c}").alias(c) for c in rest])


def training_batch(features: DataFrame, holdout: DataFrame, pending: int, seed: int = K.TRAIN_SEED, enrich: R.Enrich | None = None) -> DataFrame:
    """Rows, labels and sample weights of one batch, holdout keys left out first.

    Keys alone are sorted, joined and drawn; the drawn rows, some two hundred, then take their columns and are written once.
    With ``enrich``, gaps of the drawn rows are filled before their features are taken.
    """
    keys = materialize(DS.exclude_holdout(features.select("bout_id", "bout_date", "fight_key"), holdout).select("bout_id", "bout_date"), "batch-keys")
    drawn = materialize(DS.training_sample(keys, pending, seed), "batch-drawn")
    sample = materialize(rows_of(drawn, features), "batch-sample")
    if enrich is not None:
        sample = imputed(sample, enrich)
    factor = confidence_factor(F.when(F.col("blind_pick").isNotNull(), F.col("blind_conf")))
    return sample.withColumns({
        "label": F.coalesce((F.col("winner_side") == "a").cast("int"), F.lit(0)),
        "sample_weight": S.sample_weight(F.col("is_fresh") == 1, factor)})


def scaled_batch(batch: DataFrame, scaling: DataFrame) -> DataFrame:
    """The batch with z-scored features; ``scaling`` is one row, read as a scalar."""
    df = batch.withColumn("_s", scaling.scalar())
    means = [F.get("_s.means", F.lit(j)) for j in range(K.WIDTH)]
    stds = [F.get("_s.stds", F.lit(j)) for j in range(K.WIDTH)]
    return df.select("label", "sample_weight", *X.zscored(means, stds))


def gradient(batch: DataFrame, weights: list[float], bias: float) -> DataFrame:
    """One row: weighted gradient per feature, weighted error, and hits, each over n.

    Written as SQL expressions: one call each instead of some hundred column objects,
    which matters when a loop builds this plan once per epoch.
    """
    names = K.FEATURE_NAMES
    z = " + ".join(f"{n} * ({float(w)!r}D)" for n, w in zip(names, weights)) + f" + ({float(bias)!r}D)"
    df = batch.select("label", "sample_weight", *names, F.expr(f"1D / (1D + exp(-greatest(-500D, least(500D, {z}))))").alias("_p"))
    df = df.select(*names, F.expr("(_p - label) * sample_weight").alias("_e"), F.expr("(_p > 0.5D) = (label = 1)").alias("_hit"))
    sums = ", ".join(f"sum(_e * {n}) / count(*)" for n in names)
    return df.agg(F.expr(f"array({sums})").alias("gradient"), F.expr("sum(_e) / count(*)").alias("error"),
                  F.expr("count_if(_hit) / count(*)").alias("train_accuracy"))


def keep_masks(epochs: int = K.EPOCHS, seed: int = K.TRAIN_SEED) -> np.ndarray:
    """Which features learn in which epoch.  Each draw is a hash of (seed, epoch, feature), so that every engine draws the same."""
    rate = [K.ENRICHED_DROPOUT if j in K.ENRICHED else K.BASE_DROPOUT for j in range(K.WIDTH)]
    return np.array([[int(hashlib.md5(f"{seed}|{e}|{j}".encode()).hexdigest()[:8], 16) / 2**32 > rate[j] for j in range(K.WIDTH)] for e in range(epochs)]).reshape(epochs, K.WIDTH)


def descend(x: np.ndarray, label: np.ndarray, weight: np.ndarray, start: np.ndarray, bias: float, keep: np.ndarray) -> tuple[np.ndarray, float, list[float]]:
    """Weights, bias and the accuracy at each 50th epoch after full-batch descent over the rows of one batch.

    Features are scaled by the batch's own statistics; decay, dead zone, floors and two limits as in the constants.
    """
    scaled = (x - x.mean(axis=0)) / np.maximum(x.std(axis=0), 1e-8)
    scaled[:, K.UNSCALED] = x[:, K.UNSCALED]
    index = np.arange(K.WIDTH)
    decay = np.where(np.isin(index, K.NO_DECAY), 0.0, K.ALPHA * (1 - K.L1_RATIO))
    zone = np.where(np.isin(index, K.NO_DECAY), 0.0, K.DEAD_ZONE)
    floor = np.where(np.isin(index, K.POSITIVE_ONLY), K.POSITIVE_FLOOR, -np.inf)
    floor[10] = max(floor[10], -K.NAMED_LIMITS[10])
    w, history = np.array(start, float), []
    for epoch, on in enumerate(keep, 1):
        p = 1.0 / (1.0 + np.exp(-np.clip(scaled @ w + bias, -500.0, 500.0)))
        error = (p - label) * weight
        moved = w - K.LEARNING_RATE * (error @ scaled / len(x) + decay * w)
        moved = np.where(np.abs(moved) < zone, np.where(moved >= 0, zone, -zone), moved)
        w = np.maximum(np.where(on, moved, w), floor)
        w[32] = np.clip(w[32], -K.NAMED_LIMITS[32], K.NAMED_LIMITS[32])
        bias -= K.LEARNING_RATE * float(error.sum()) / len(x)
        if epoch % 50 == 0:
            history.append(float(np.mean((p > 0.5) == (label == 1))))
    return w, bias, history


def fit_groups(rows: DataFrame, models: DataFrame, key: str, epochs: int = K.EPOCHS, seed: int = K.TRAIN_SEED) -> DataFrame:
    """``models`` (key, weights, bias) with new_weights, new_bias and train_accuracy after training on the rows of their key.

    A key's rows are one training batch (label, sample_weight, features): some two hundred rows by the rules of
    `training_sample`, so each batch is the work of one task and batches of many models train side by side.
    """
    keep = keep_masks(epochs, seed)

    def run(batch: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        if not len(model):
            return pd.DataFrame(columns=[key, "new_weights", "new_bias", "train_accuracy"])
        w, b, history = np.array(model["weights"][0], float), float(model["bias"][0]), []
        if len(batch):
            # a fixed order of the rows fixes the order of the sums
            batch = batch.sort_values([*K.FEATURE_NAMES, "label", "sample_weight"])
            w, b, history = descend(batch[K.FEATURE_NAMES].to_numpy(float), batch["label"].to_numpy(float), batch["sample_weight"].to_numpy(float), w, b, keep)
        return pd.DataFrame({key: model[key][:1], "new_weights": [w.tolist()], "new_bias": [b], "train_accuracy": [history]})

    kind = models.schema[key].dataType.simpleString()
    out = rows.select(key, "label", "sample_weight", *K.FEATURE_NAMES).groupBy(key).cogroup(models.select(key, "weights", "bias").groupBy(key))
    return models.join(out.applyInPandas(run, f"{key} {kind}, new_weights array<double>, new_bias double, train_accuracy array<double>"), key)


def train_incremental(features: DataFrame, holdout: DataFrame, models: DataFrame, pending: int, best_accuracy: float,
                      epochs: int = K.EPOCHS, seed: int = K.TRAIN_SEED, enrich: R.Enrich | None = None) -> DataFrame:
    """One batch cycle for each of ``models`` (model_id, weights, bias, means, stds): sample, fit, guarded half step, evaluation, verdict.

    Under ten rows nothing is trained: status is "too few bouts" and the model comes back as it was.  ``promoted`` says whether the
    trained model beats the best accuracy so far.
    """
    batch = materialize(training_batch(features, holdout, pending, seed, enrich), "batch")
    enough = F.lit(batch.count() >= 10)
    rows = batch.select("label", "sample_weight", *K.FEATURE_NAMES, F.explode(models.agg(F.collect_set("model_id")).scalar()).alias("model_id"))
    after = M.update_weights(fit_groups(rows, models, "model_id", epochs, seed)).select(
        "model_id", F.when(enough, F.col("updated")).otherwise(F.col("weights")).alias("weights"), F.when(enough, F.col("updated_bias")).otherwise(F.col("bias")).alias("bias"),
        "means", "stds", F.when(enough, F.col("train_accuracy")).alias("train_accuracy"))
    after = materialize(after, "trained")
    rows = materialize(slice_rows(features), "slice")
    rated = M.accuracy_on_slice(after, rows)
    accuracy = F.when(rows.select(F.size("rows")).scalar() >= 5, F.col("slice_accuracy")).otherwise(0.0)
    return after.join(rated, "model_id").withColumns({
        "status": F.when(enough, "trained").otherwise("too few bouts"), "accuracy": accuracy, "promoted": enough & (accuracy / 100.0 > best_accuracy)}).drop("slice_accuracy")


def slice_rows(features: DataFrame) -> DataFrame:
    """The evaluation slice as one scalar ``rows``: an array of at most 100 (x, a_won)."""
    one = F.struct(F.array(*K.FEATURE_NAMES).alias("x"), (F.col("winner_side") == "a").alias("a_won"))
    return DS.eval_slice(features).agg(F.collect_list(one).alias("rows"))
