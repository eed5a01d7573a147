"""Model bundles, many versions at once: sanitising, comparing, updating, governing.

A bundle is one row (model_id, weights, bias, means, stds).  Everything here is a
row expression over arrays of at most 46 elements, so nothing is shuffled except
where two versions are joined.

Computed arrays are unfolded with the outer generators.  For the plain ones Spark
infers a filter "array is not empty", pushes it below the projections, and expands
the whole computation once more inside it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutlens import constants as K
from boutlens.operators.scoring import predict_proba


def _table(values: dict[int, float]) -> Column:
    """A 46-slot lookup; null where no value applies."""
    return F.array(*[F.lit(values.get(i)).cast("double") for i in range(K.WIDTH)])


_LIMITS = dict(K.NAMED_LIMITS)
_FLOORS = {i: max(K.POSITIVE_FLOOR if i in K.POSITIVE_ONLY else 0.0, K.USEFUL_FLOORS.get(i, 0.0))
           for i in {*K.POSITIVE_ONLY, *K.USEFUL_FLOORS}}
_PARTNER = {x: y for _, i, j, _b in K.PAIR_LIMITS for x, y in ((i, j), (j, i))}
_PAIR_BOUND = {x: b for _, i, j, b in K.PAIR_LIMITS for x in (i, j)}


def _clip(w: Column, limit: Column) -> Column:
    """Into -limit..limit; a null limit or a NaN weight changes nothing."""
    return F.when(limit.isNull() | F.isnan(w), w).when(w > limit, limit).when(w < -limit, -limit).otherwise(w)


def _floor(w: Column, floor: Column) -> Column:
    return F.when(floor.isNotNull() & ~F.isnan(w) & (w < floor), floor).otherwise(w)


def _each(arr: Column, fn) -> Column:
    return F.transform(arr, fn)


def fit_width(arr: Column, fill: float) -> Column:
    """Cut to 46 or pad with ``fill``."""
    padded = F.concat(F.coalesce(arr, F.array().cast("array<double>")), F.array_repeat(F.lit(fill), K.WIDTH))
    return F.slice(padded, 1, K.WIDTH)


def sanitize(df: DataFrame) -> DataFrame:
    """Bring loaded bundles to 46 columns, inside the named limits and above the floors.

    Record means above 1 were stored before the division by 100 and are rescaled
    together with their stds.  A bias over 0.3 in size is reset.
    """
    df = df.withColumns({"weights": fit_width(F.col("weights"), 0.001), "means": fit_width(F.col("means"), 0.0),
                         "stds": fit_width(F.col("stds"), 1.0)})
    limits, floors = _table(_LIMITS), _table(_FLOORS)
    weights = _each(F.col("weights"), lambda w, i: _floor(_clip(w, F.get(limits, i)), F.get(floors, i)))
    record = _table({i: 1.0 for i in K.RECORD_INDEXES})

    def stale(i: Column) -> Column:
        return F.get(record, i).isNotNull() & (F.get(F.col("means"), i) > 1.0)

    # The stds first and on their own: inside a lambda, "means" would otherwise resolve to the new column.
    df = df.withColumn("stds", _each(F.col("stds"), lambda s, i: F.when(stale(i), s / 100.0).otherwise(s)))
    return df.withColumns({
        "weights": weights,
        "means": _each(F.col("means"), lambda m, i: F.when(F.get(record, i).isNotNull() & (m > 1.0), m / 100.0).otherwise(m)),
        "bias": F.when(F.abs("bias") > K.BIAS_RESET, 0.0).otherwise(F.col("bias"))})


def explode_bundle(df: DataFrame) -> DataFrame:
    """(model_id, idx, name, weight, mean, std), one row per feature."""
    names = F.array(*[F.lit(n) for n in K.FEATURE_NAMES])
    zipped = F.arrays_zip(names.alias("name"), F.col("weights").alias("weight"), F.col("means").alias("mean"), F.col("stds").alias("std"))
    out = df.select("model_id", F.posexplode_outer(zipped).alias("idx", "z"))
    return out.select("model_id", "idx", "z.name", "z.weight", "z.mean", "z.std")


def changes(df: DataFrame, old: str = "weights", new: str = "new_weights", least: float = 1e-6) -> DataFrame:
    """Add ``changes``: array of (size, idx, name, old, new, diff) by falling size, then index."""
    names = F.array(*[F.lit(n) for n in K.FEATURE_NAMES])
    items = F.transform(F.arrays_zip(F.col(old).alias("o"), F.col(new).alias("n")), lambda z, i: F.struct(
        (-F.abs(z["n"] - z["o"])).alias("neg"), i.alias("idx"), F.get(names, i).alias("name"),
        z["o"].alias("old"), z["n"].alias("new"), (z["n"] - z["o"]).alias("diff")))
    return df.withColumn("changes", F.array_sort(F.filter(items, lambda c: c["neg"] < -least)))


def change_summary(df: DataFrame) -> DataFrame:
    """Number, mean and largest size of the changes per row of `changes`."""
    n = F.size("changes")
    total = F.aggregate("changes", F.lit(0.0), lambda s, c: s - c["neg"])
    top = F.try_element_at("changes", F.lit(1))
    return df.withColumns({"n_changed": n, "mean_change": F.when(n > 0, total / n).otherwise(F.lit(0.0)),
                           "max_change": F.coalesce(-top["neg"], F.lit(0.0)), "max_name": F.coalesce(top["name"], F.lit(""))})


def frozen(old: Column, new: Column) -> Column:
    """Indexes whose weight moved by less than 0.00001."""
    idx = F.transform(F.arrays_zip(old.alias("o"), new.alias("n")),
                      lambda z, i: F.when(F.abs(z["n"] - z["o"]) < K.STEP_MIN, i))
    return F.filter(idx, lambda i: i.isNotNull())


def _pair_fix(w: Column, other: Column, limit: Column) -> Column:
    shrunk = _clip(w * (limit / F.greatest(F.abs(w), F.abs(other))), limit)
    return (F.when(limit.isNull() | (F.abs(w) <= limit), w).when(F.abs(other) <= limit, _clip(w, limit))
            .otherwise(F.when(F.abs(w - shrunk) > 0.0001, shrunk).otherwise(w)))


def constrain_pairs(weights: str) -> Column:
    """Pair limits.  One weight out: clip it.  Both out: shrink both by one factor, then clip.

    Each weight is zipped with its partner and their bound, so one short rule serves all 46.
    """
    partners = F.array(*[F.get(weights, F.lit(_PARTNER[j])) if j in _PARTNER else F.lit(None).cast("double") for j in range(K.WIDTH)])
    zipped = F.arrays_zip(F.col(weights).alias("w"), partners.alias("other"), _table(_PAIR_BOUND).alias("bound"))
    return F.transform(zipped, lambda z: _pair_fix(z["w"], z["other"], z["bound"]))


def pair_rows(df: DataFrame) -> DataFrame:
    """Pair statistics, 20 rows per bundle."""
    w = F.col("weights")
    items = [F.struct(F.lit(name).alias("pair"), F.get(w, F.lit(i)).alias("w1"), F.get(w, F.lit(j)).alias("w2"), F.lit(b).alias("bound"))
             for name, i, j, b in K.PAIR_LIMITS]
    long = df.select("model_id", F.inline(F.array(*items)))
    return long.withColumns({
        "total": F.floor((F.col("w1") + F.col("w2")) * 10000.0 + 0.5) / 10000.0,
        "gap": F.floor(F.abs(F.col("w1") - F.col("w2")) * 10000.0 + 0.5) / 10000.0,
        "in_bounds": ((F.abs("w1") <= F.col("bound")) & (F.abs("w2") <= F.col("bound"))).cast("int")})


def limit_hits(weights: Column) -> Column:
    """Names of features at their named limit, or at the general limit of 0.1."""
    limits, names = _table(_LIMITS), F.array(*[F.lit(n) for n in K.FEATURE_NAMES])
    at = F.transform(weights, lambda w, i: F.when(
        (F.abs(w) >= K.GENERAL_LIMIT - K.LIMIT_SLACK) | F.coalesce(F.abs(w) >= F.get(limits, i) - K.LIMIT_SLACK, F.lit(False)), F.get(names, i)))
    return F.filter(at, lambda n: n.isNotNull())


def update_weights(df: DataFrame) -> DataFrame:
    """Move stored weights half way to ``new_weights`` and apply every guard, in this order.

    Half step, clip by the spread of the feature, named limits, floors, age limit,
    lift off zero, repair of NaN, pair limits.  The order is part of the result: the
    lift may undo an earlier limit.  The bias is reset beyond 0.3, then kept in +-0.05.

    Each stage zips what a weight needs into one array and maps a short rule over it.  What is one value for all weights
    (the lift) is repeated into the zip: inside a rule its definition would be evaluated again for every element.
    """
    keep = df.columns

    def settle(z: Column) -> Column:
        o, n, sd = z["o"], z["n"], z["s"]
        half = F.when(~F.isnan(n - o) & (F.abs(n - o) > K.STEP_MIN), o + (n - o) * K.STEP_SHARE).otherwise(o)
        spread = K.ADAPTIVE_CLIP / (F.when(sd < 1e-8, F.lit(1.0)).otherwise(sd) + 1e-8)
        return _clip(_floor(_clip(_clip(half, spread), z["limit"]), z["floor"]), z["age"])

    fixed = F.arrays_zip(F.col("weights").alias("o"), F.col("new_weights").alias("n"), F.col("stds").alias("s"), _table(_LIMITS).alias("limit"),
                         _table(_FLOORS).alias("floor"), _table(dict.fromkeys(K.UNSCALED, K.AGE_LIMIT)).alias("age"))
    df = df.withColumn("_c", F.transform(fixed, settle))
    df = df.withColumn("_total", F.aggregate("_c", F.lit(0.0), lambda s, w: s + F.abs(w)))
    usable = ~F.isnan("_total") & (F.col("_total") > 0)
    df = df.withColumn("_lift", F.when(usable, F.greatest(F.col("_total") / K.WIDTH * 0.01, F.lit(0.00001))).otherwise(F.lit(0.0001)))

    def lift_and_repair(z: Column) -> Column:
        w, new, least = z["w"], z["n"], z["lift"]
        repaired = F.when(F.isnan(new), F.lit(0.001)).otherwise(new)
        return (F.when(F.isnan(w) | (F.abs(w) == float("inf")), repaired)
                .when((F.abs(w) < least) & (w >= 0), least).when(F.abs(w) < least, -least).otherwise(w))

    lifts = F.array_repeat("_lift", K.WIDTH)
    df = df.withColumn("_w", F.transform(F.arrays_zip(F.col("_c").alias("w"), F.col("new_weights").alias("n"), lifts.alias("lift")), lift_and_repair))
    finite = ~F.isnan("new_bias") & (F.abs("new_bias") <= K.BIAS_RESET)
    bias = F.when(finite, F.greatest(F.lit(-K.BIAS_LIMIT), F.least(F.lit(K.BIAS_LIMIT), F.col("new_bias")))).otherwise(F.lit(0.0))
    return df.select(*keep, constrain_pairs("_w").alias("updated"), bias.alias("updated_bias"))


def settled(old: np.ndarray, new: np.ndarray, stds: np.ndarray, bias: float) -> tuple[np.ndarray, float]:
    """`update_weights` of one model as arrays, for chains of many updates inside a task: the same rules in the same order."""
    def table(values: dict[int, float]) -> np.ndarray:
        return np.array([values.get(i, np.nan) for i in range(K.WIDTH)], float)

    def clip(w: np.ndarray, limit: np.ndarray) -> np.ndarray:
        return np.where(np.isnan(limit) | np.isnan(w), w, np.clip(w, -np.abs(limit), np.abs(limit)))

    with np.errstate(all="ignore"):
        half = np.where(np.abs(new - old) > K.STEP_MIN, old + (new - old) * K.STEP_SHARE, old)
        spread = K.ADAPTIVE_CLIP / (np.where(stds < 1e-8, 1.0, stds) + 1e-8)
        c = clip(np.where(np.isnan(spread), np.nan, clip(half, spread)), table(_LIMITS))
        floor = table(_FLOORS)
        c = clip(np.where(c < floor, floor, c), table(dict.fromkeys(K.UNSCALED, K.AGE_LIMIT)))
        total = sum(np.abs(c).tolist())
        lift = max(total / K.WIDTH * 0.01, 0.00001) if total > 0 else 0.0001
        w = np.where(np.isfinite(c), np.where(np.abs(c) < lift, np.where(c >= 0, lift, -lift), c), np.where(np.isnan(new), 0.001, new))
        bound, other = table(_PAIR_BOUND), np.array([w[_PARTNER[j]] if j in _PARTNER else np.nan for j in range(K.WIDTH)])
        shrunk = clip(w * (bound / np.maximum(np.abs(w), np.abs(other))), bound)
        # NaN is larger than any number in Spark
        both = np.where((np.abs(w - shrunk) > 0.0001) | np.isnan(w - shrunk), shrunk, w)
        w = np.where(np.isnan(bound) | (np.abs(w) <= bound), w, np.where(np.abs(other) <= bound, clip(w, bound), both))
    return w, max(-K.BIAS_LIMIT, min(K.BIAS_LIMIT, bias)) if abs(bias) <= K.BIAS_RESET else 0.0


def accuracy_on_slice(models: DataFrame, rows: DataFrame, prefix: str = "") -> DataFrame:
    """Accuracy in percent (``slice_accuracy``) of every model on one slice.

    ``rows`` is a one-row frame holding the slice as an array of (x, a_won); a slice has
    at most 100 rows by definition, so it travels as one scalar and every model unfolds
    it in place.  The mean is combined before the shuffle, to one row per model.
    """
    names = [f"{prefix}{c}" for c in ("weights", "bias", "means", "stds")]
    wide = models.select("model_id", *[F.col(n).alias(c) for n, c in zip(names, ("weights", "bias", "means", "stds"))])
    unfolded = wide.withColumn("_rows", rows.scalar()).select("model_id", "weights", "bias", "means", "stds", F.inline_outer("_rows"))
    columns = unfolded.select("*", *[F.get("x", F.lit(j)).alias(n) for j, n in enumerate(K.FEATURE_NAMES)])
    means, stds, weights = ([F.get(c, F.lit(j)) for j in range(K.WIDTH)] for c in ("means", "stds", "weights"))
    proba = predict_proba(weights, F.col("bias"), means, stds)
    hit = F.coalesce(((proba > 0.5) == F.col("a_won")).cast("double"), F.lit(0.0))
    return columns.groupBy("model_id").agg((F.avg(hit) * 100.0).alias("slice_accuracy"))


def rollback(df: DataFrame, lineage: str) -> DataFrame:
    """Restore the lineage's best version where a model fell more than 0.04 behind it.

    The best row per lineage is one aggregate, combined before the shuffle.
    """
    best = df.groupBy(lineage).agg(F.max(F.struct("accuracy", (-F.col("model_id")).alias("order"), "bias")).alias("best"))
    joined = df.join(best, lineage)
    drop = F.col("best.accuracy") - F.col("accuracy")
    restore = (drop > K.ROLLBACK_DROP) & (F.col("best.accuracy") > 0.001)
    kept = F.when(restore, F.col("best.bias")).otherwise(F.col("bias"))
    return joined.select("model_id", lineage, "accuracy", F.col("best.accuracy").alias("best_accuracy"), restore.cast("int").alias("restored"),
                         F.when(restore, -F.col("best.order")).otherwise(F.col("model_id")).alias("active_model"),
                         F.when(restore & (F.abs(kept) > K.BIAS_RESET), 0.0).otherwise(kept).alias("active_bias"))


def drift_scaler(df: DataFrame, recent: Column, alpha: float = K.SCALER_ALPHA) -> DataFrame:
    """Move stored means and stds a little towards those of the recent rows (struct of arrays)."""
    def blend(old: str, new: str) -> Column:
        return F.zip_with(F.col(old), recent[new], lambda o, n: (1 - alpha) * o + alpha * n)

    return df.withColumns({"means": blend("means", "means"), "stds": blend("stds", "stds")})


def contributions(weights: list[float], least: float = 0.0001) -> Column:
    """Array of (neg, idx, name, value) by falling size; raw features, tiny ones dropped."""
    items = [F.struct((-F.abs(F.col(n) * w)).alias("neg"), F.lit(i).alias("idx"), F.lit(n).alias("name"), (F.col(n) * w).alias("value"))
             for i, (n, w) in enumerate(zip(K.FEATURE_NAMES, weights))]
    return F.array_sort(F.filter(F.array(*items), lambda c: c["neg"] < -least))


def top_contributors(scaled: list[str], weights: list[float], sign: str, k: int = 3) -> Column:
    """The ``k`` features that pushed most towards the predicted side (``sign``: column of 1 or -1)."""
    items = [F.struct((-F.col(sign) * F.col(c) * w).alias("neg"), F.lit(i).alias("idx"), F.lit(K.FEATURE_NAMES[i]).alias("name"))
             for i, (c, w) in enumerate(zip(scaled, weights))]
    return F.slice(F.array_sort(F.array(*items)), 1, k)
