"""Model queries: bundles, comparisons, updates, governance."""

from __future__ import annotations

from pyspark.sql import functions as F

from boutlens import constants as K
from boutlens.catalog import query
from boutlens.catalog import sqlkit as Q
from boutlens.functions.numbers import r6
from boutlens.operators import dataset as DS
from boutlens.operators import features as X
from boutlens.operators import models as M
from boutlens.operators.history import latest
from boutlens.plans import flows, training
from boutlens.session import materialize
from boutlens.sources import tables

NAMES = Q.lst(K.FEATURE_NAMES)


def _ragged(spark, d):
    """Bundles of 40, 50 or 46 weights, with short or long statistics."""
    v = F.col("vec_id")
    width = F.when(v % 3 == 0, 40).when(v % 3 == 1, 50).otherwise(46)
    df = tables.model_versions(spark, d).withColumnRenamed("model_id", "vec_id").drop("weights")
    raw = tables.table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("w"))
    return df.join(raw, "vec_id").select(v.alias("model_id"), F.slice("w", 1, width).alias("weights"), "bias",
                                         F.slice("means", 1, F.when(v % 2 == 0, 30).otherwise(46)).alias("means"), "stds")


Q.cte("models", [], """SELECT vec_id AS model_id, CAST(embedding[1:46] AS DOUBLE[]) AS weights, CAST(embedding AS DOUBLE[]) AS raw, label,
  (vec_id % 81 - 40) / 100.0::DOUBLE AS bias, list_transform(range(0, 46), lambda j: ((vec_id + j * 7) % 300) / 100.0::DOUBLE) AS means,
  list_transform(range(0, 46), lambda j: ((vec_id + j * 11) % 50) / 10.0::DOUBLE) AS stds, ((vec_id * 7919) % 1000) / 1000.0::DOUBLE AS accuracy FROM embeddings""")
Q.cte("mlong", ["models"], f"""SELECT model_id, bias, label, accuracy, j AS idx, ({NAMES})[j + 1] AS name, weights[j + 1] AS weight, means[j + 1] AS mean, stds[j + 1] AS std,
  raw[j + 1] AS rawv FROM models, (SELECT unnest(range(0, 46)) AS j)""")


def _case(values: dict, col: str = "idx") -> str:
    return f"(CASE {col} " + " ".join(f"WHEN {k} THEN {v}::DOUBLE" for k, v in values.items()) + " END)"


LIM, FLO, AGE = _case(M._LIMITS), _case(M._FLOORS), _case({5: 0.1, 22: 0.1})


def clip_sql(x: str, lim: str) -> str:
    return f"(CASE WHEN {lim} IS NULL THEN {x} WHEN {x} > {lim} THEN {lim} WHEN {x} < -{lim} THEN -{lim} ELSE {x} END)"


def floor_sql(x: str, flo: str) -> str:
    return f"(CASE WHEN {flo} IS NOT NULL AND {x} < {flo} THEN {flo} ELSE {x} END)"


@query("weights_explode", Q.with_(["mlong"], f"SELECT model_id, idx, name, {Q.r6('weight')} AS weight, {Q.r6('mean')} AS mean, {Q.r6('std')} AS std FROM mlong"))
def weights_explode(spark, d):
    out = M.explode_bundle(tables.model_versions(spark, d))
    return out.select("model_id", "idx", "name", *[r6(F.col(c)).alias(c) for c in ("weight", "mean", "std")])


_stale = "(idx IN (9, 10, 26, 27) AND m > 1.0)"


@query("weights_sanitize", Q.with_(["mlong"], f"""SELECT model_id, idx, {Q.r6(floor_sql(clip_sql('w', LIM), FLO))} AS weight,
  {Q.r6(f'CASE WHEN {_stale} THEN m / 100.0::DOUBLE ELSE m END')} AS mean, {Q.r6(f'CASE WHEN {_stale} THEN std / 100.0::DOUBLE ELSE std END')} AS std,
  CASE WHEN abs(bias) > 0.3 THEN 0.0::DOUBLE ELSE bias END AS bias FROM (SELECT *,
  CASE WHEN model_id % 3 = 0 AND idx >= 40 THEN 0.001::DOUBLE ELSE rawv END AS w, CASE WHEN model_id % 2 = 0 AND idx >= 30 THEN 0.0::DOUBLE ELSE mean END AS m FROM mlong)"""))
def weights_sanitize(spark, d):
    fixed = M.sanitize(_ragged(spark, d))
    out = M.explode_bundle(fixed).join(fixed.select("model_id", "bias"), "model_id")
    return out.select("model_id", "idx", *[r6(F.col(c)).alias(c) for c in ("weight", "mean", "std")], "bias")


def pairs(spark, d):
    """Current version (even id) with its candidate (next id); every ninth weight is left as it was."""
    m = tables.model_versions(spark, d)
    new = m.select((F.col("model_id") - 1).alias("model_id"), F.col("weights").alias("w2"), F.col("bias").alias("new_bias"),
                   F.col("means").alias("new_means"), F.col("stds").alias("new_stds"), F.col("accuracy").alias("new_accuracy"))
    joined = m.filter(F.col("model_id") % 2 == 0).join(new, "model_id")
    kept = F.transform(F.arrays_zip(F.col("weights").alias("o"), F.col("w2").alias("n")), lambda z, i: F.when(i % 9 == 0, z["o"]).otherwise(z["n"]))
    return joined.withColumn("new_weights", kept).drop("w2")


Q.cte("mpairs", ["mlong"], """SELECT c.model_id, c.idx, c.name, c.weight, c.std, c.bias, n.bias AS new_bias, CASE WHEN c.idx % 9 = 0 THEN c.weight ELSE n.weight END AS new_weight,
  CASE WHEN c.idx % 9 = 0 THEN 0.0::DOUBLE ELSE n.weight - c.weight END AS diff FROM mlong c JOIN mlong n ON n.model_id = c.model_id + 1 AND n.idx = c.idx WHERE c.model_id % 2 = 0""")


@query("weights_diff", Q.with_(["mpairs"], f"SELECT model_id, idx, name, {Q.r6('diff')} AS diff FROM mpairs WHERE abs(diff) > 0.000001"))
def weights_diff(spark, d):
    out = M.changes(pairs(spark, d)).select("model_id", F.inline_outer("changes")).filter("idx IS NOT NULL")
    return out.select("model_id", "idx", "name", r6(F.col("diff")).alias("diff"))


@query("weights_diff_summary", Q.with_(["mpairs"], f"""SELECT model_id, CAST(count(*) AS INT) AS n_changed, {Q.r6('avg(abs(diff))')} AS mean_change,
  {Q.r6('max(abs(diff))')} AS max_change, arg_max(name, abs(diff)) AS max_name FROM mpairs WHERE abs(diff) > 0.000001 GROUP BY 1"""))
def weights_diff_summary(spark, d):
    out = M.change_summary(M.changes(pairs(spark, d)))
    return out.select("model_id", "n_changed", r6(F.col("mean_change")).alias("mean_change"), r6(F.col("max_change")).alias("max_change"), "max_name")


@query("weights_top_changes", Q.with_(["mpairs"], f"""SELECT model_id, CAST(rn AS INT) AS rank, name, {Q.r6('diff')} AS diff FROM (SELECT *, row_number() OVER
  (PARTITION BY model_id ORDER BY abs(diff) DESC, idx) AS rn FROM mpairs WHERE abs(diff) > 0.000001) WHERE rn <= 20"""))
def weights_top_changes(spark, d):
    out = M.changes(pairs(spark, d)).select("model_id", F.posexplode_outer(F.slice("changes", 1, 20)).alias("p", "c")).filter("p IS NOT NULL")
    return out.select("model_id", (F.col("p") + 1).alias("rank"), F.col("c.name").alias("name"), r6(F.col("c.diff")).alias("diff"))


@query("frozen_weights", Q.with_(["mpairs"], """SELECT model_id, CAST(count(*) AS INT) AS n_frozen, string_agg(CAST(idx AS VARCHAR), ',' ORDER BY idx) AS indexes
  FROM mpairs WHERE abs(diff) < 0.00001 GROUP BY 1"""))
def frozen_weights(spark, d):
    df = pairs(spark, d).withColumn("f", M.frozen(F.col("weights"), F.col("new_weights")))
    return df.filter(F.size("f") > 0).select("model_id", F.size("f").alias("n_frozen"), F.array_join("f", ",").alias("indexes"))


PAIR_DIM = "(VALUES " + ", ".join(f"('{n}', {i}, {j}, {b}::DOUBLE)" for n, i, j, b in K.PAIR_LIMITS) + ") AS dim(pair, i, j, bound)"
PARTNER_DIM = "(VALUES " + ", ".join(f"({x}, {y}, {b}::DOUBLE)" for _, i, j, b in K.PAIR_LIMITS for x, y in ((i, j), (j, i))) + ") AS part(me, other, bound)"


def constrain_sql(src: str, key: str, extra: str = "") -> str:
    """Pair limits over a long table (key, idx, w)."""
    shrunk = clip_sql("(a.w * (bound / greatest(abs(a.w), abs(b.w))))", "bound")
    return f"""SELECT a.{key}, a.idx{extra}, CASE WHEN bound IS NULL OR abs(a.w) <= bound THEN a.w WHEN abs(b.w) <= bound THEN {clip_sql('a.w', 'bound')}
      ELSE CASE WHEN abs(a.w - {shrunk}) > 0.0001 THEN {shrunk} ELSE a.w END END AS w2, a.w
      FROM {src} a LEFT JOIN {PARTNER_DIM} ON me = a.idx LEFT JOIN {src} b ON b.{key} = a.{key} AND b.idx = other"""


@query("pair_constraints", Q.with_(["mlong"], "").rstrip() + f""",
l AS (SELECT model_id, idx, weight AS w FROM mlong), c AS ({constrain_sql('l', 'model_id')})
SELECT model_id, idx, {Q.r6('w2')} AS weight, CASE WHEN w2 <> w THEN 1 ELSE 0 END AS corrected FROM c""")
def pair_constraints(spark, d):
    df = tables.model_versions(spark, d).withColumn("fixed", M.constrain_pairs("weights"))
    out = df.select("model_id", F.posexplode_outer(F.arrays_zip(F.col("weights").alias("o"), F.col("fixed").alias("n"))).alias("idx", "z"))
    return out.select("model_id", "idx", r6(F.col("z.n")).alias("weight"), (F.col("z.n") != F.col("z.o")).cast("int").alias("corrected"))


_PAIRS_SQL = f"""SELECT a.model_id, pair, {Q.r6('a.weight')} AS w1, {Q.r6('b.weight')} AS w2, floor((a.weight + b.weight) * 10000.0::DOUBLE + 0.5) / 10000.0::DOUBLE AS total,
  floor(abs(a.weight - b.weight) * 10000.0::DOUBLE + 0.5) / 10000.0::DOUBLE AS gap, CASE WHEN abs(a.weight) <= bound AND abs(b.weight) <= bound THEN 1 ELSE 0 END AS in_bounds
  FROM {PAIR_DIM} JOIN mlong a ON a.idx = i JOIN mlong b ON b.model_id = a.model_id AND b.idx = j"""


def _pair_rows(spark, d):
    return M.pair_rows(tables.model_versions(spark, d)).select(
        "model_id", "pair", r6(F.col("w1")).alias("w1"), r6(F.col("w2")).alias("w2"), "total", "gap", "in_bounds")


query("pair_stats", Q.with_(["mlong"], _PAIRS_SQL))(_pair_rows)
query("pair_violations", Q.with_(["mlong"], f"SELECT model_id, pair, w1, w2 FROM ({_PAIRS_SQL}) WHERE in_bounds = 0"))(
    lambda spark, d: _pair_rows(spark, d).filter("in_bounds = 0").select("model_id", "pair", "w1", "w2"))


@query("weight_limit_hits", Q.with_(["mlong"], f"""SELECT model_id, string_agg(name, ',' ORDER BY idx) AS hits FROM mlong
  WHERE abs(weight) >= 0.1 - 0.0001 OR abs(weight) >= {LIM} - 0.0001 GROUP BY 1"""))
def weight_limit_hits(spark, d):
    df = tables.model_versions(spark, d).select("model_id", F.array_join(M.limit_hits(F.col("weights")), ",").alias("hits"))
    return df.filter("hits <> ''")


_half = "CASE WHEN abs(diff) > 0.00001 THEN weight + diff * 0.5 ELSE weight END"
_spread = "(0.5::DOUBLE / (CASE WHEN std < 1e-8 THEN 1.0::DOUBLE ELSE std END + 1e-8::DOUBLE))"


@query("weights_update", Q.with_(["mpairs"], "").rstrip() + f""",
u1 AS (SELECT model_id, idx, new_bias, std, {_half} AS w FROM mpairs),
u2 AS (SELECT model_id, idx, new_bias, {clip_sql('w', _spread)} AS w FROM u1),
u3 AS (SELECT model_id, idx, new_bias, {clip_sql('w', LIM)} AS w FROM u2),
u4 AS (SELECT model_id, idx, new_bias, {floor_sql('w', FLO)} AS w FROM u3),
u5 AS (SELECT model_id, idx, new_bias, {clip_sql('w', AGE)} AS w FROM u4),
t AS (SELECT model_id, greatest(sum(abs(w)) / 46 * 0.01, 0.00001::DOUBLE) AS lift FROM u5 GROUP BY 1),
u6 AS (SELECT u5.model_id, idx, new_bias, CASE WHEN abs(w) < lift THEN CASE WHEN w >= 0 THEN lift ELSE -lift END ELSE w END AS w FROM u5 JOIN t USING (model_id)),
u7 AS ({constrain_sql('u6', 'model_id', ', a.new_bias')})
SELECT model_id, idx, {Q.r6('w2')} AS weight, CASE WHEN abs(new_bias) > 0.3 THEN 0.0::DOUBLE ELSE greatest(-0.05::DOUBLE, least(0.05::DOUBLE, new_bias)) END AS bias FROM u7""")
def weights_update(spark, d):
    df = M.update_weights(pairs(spark, d)).select("model_id", "updated_bias", F.posexplode_outer("updated").alias("idx", "w"))
    return df.select("model_id", "idx", r6(F.col("w")).alias("weight"), F.col("updated_bias").alias("bias"))


def eval_rows(spark, d):
    """The evaluation slice as one scalar: an array of at most 100 (features, a_won)."""
    return training.slice_rows(flows.bout_features(spark, d))


_XS = "[" + ", ".join(f"CAST({n} AS DOUBLE)" for n in K.FEATURE_NAMES) + "]"


def _acc_sql(p: str, w: str) -> str:
    z = (f"list_sum(list_transform(range(0, 46), lambda j: (CASE WHEN j IN (5, 22) THEN x[j + 1] ELSE (x[j + 1] - {p}means[j + 1]) / "
         f"(CASE WHEN {p}stds[j + 1] <= 1e-12 THEN 1.0 ELSE {p}stds[j + 1] END) END) * {w}[j + 1])) + {p}bias")
    return f"avg(CASE WHEN side IS NOT NULL AND ({z} > 0) = (side = 'a') THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END)"


@query("champion_challenger", Q.with_(["models", "feats"], "").rstrip() + f""",
slice AS MATERIALIZED (SELECT {_XS} AS x, winner_side AS side FROM (SELECT *, row_number() OVER (ORDER BY bout_date DESC, bout_id DESC) AS e FROM feats) WHERE e BETWEEN 101 AND 200),
p AS MATERIALIZED (SELECT c.*, n.means AS nmeans, n.stds AS nstds, n.bias AS nbias, list_transform(range(0, 46), lambda j: CASE WHEN j % 9 = 0 THEN c.weights[j + 1] ELSE n.weights[j + 1] END) AS nw
  FROM models c JOIN models n ON n.model_id = c.model_id + 1 WHERE c.model_id % 2 = 0),
s AS (SELECT model_id, accuracy, {_acc_sql('', 'weights')} AS champion, {_acc_sql('n', 'nw')} AS challenger FROM p, slice GROUP BY 1, 2)
SELECT model_id, {Q.r6('champion')} AS champion, {Q.r6('challenger')} AS challenger, CASE WHEN challenger / 100.0 > accuracy THEN 1 ELSE 0 END AS promoted FROM s""")
def champion_challenger(spark, d):
    df, rows = pairs(spark, d), eval_rows(spark, d)
    old = M.accuracy_on_slice(df, rows).withColumnRenamed("slice_accuracy", "champion")
    new = M.accuracy_on_slice(df, rows, "new_").withColumnRenamed("slice_accuracy", "challenger")
    out = df.select("model_id", "accuracy").join(old, "model_id").join(new, "model_id")
    return out.select("model_id", r6(F.col("champion")).alias("champion"), r6(F.col("challenger")).alias("challenger"),
                      (F.col("challenger") / 100.0 > F.col("accuracy")).cast("int").alias("promoted"))


@query("rollback_rule", Q.with_(["models"], """SELECT m.model_id, m.label, m.accuracy, b.accuracy AS best_accuracy, CASE WHEN r THEN 1 ELSE 0 END AS restored,
  CASE WHEN r THEN b.model_id ELSE m.model_id END AS active_model, CASE WHEN r THEN CASE WHEN abs(b.bias) > 0.3 THEN 0.0::DOUBLE ELSE b.bias END ELSE m.bias END AS active_bias
  FROM (SELECT m.*, b.accuracy - m.accuracy > 0.04 AND b.accuracy > 0.001 AS r FROM models m JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY accuracy DESC, model_id) AS rn FROM models) WHERE rn = 1) b USING (label)) m
  JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY accuracy DESC, model_id) AS rn FROM models) WHERE rn = 1) b USING (label)"""))
def rollback_rule(spark, d):
    return M.rollback(tables.model_versions(spark, d), "label")


@query("scaler_ewma", Q.with_(["mlong", "feats"], "").rstrip() + f""",
lastf AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY bout_date DESC, bout_id DESC) AS e FROM feats) WHERE e <= 500),
st AS MATERIALIZED ({" UNION ALL ".join(f"SELECT {i} AS idx, avg({n}) AS rm, CASE WHEN var_pop({n}) > 1e-8 THEN stddev_pop({n}) ELSE 1.0::DOUBLE END AS rs FROM lastf" for i, n in enumerate(K.FEATURE_NAMES))})
SELECT model_id, idx, {Q.r6('0.995::DOUBLE * mean + 0.005::DOUBLE * rm')} AS mean, {Q.r6('0.995::DOUBLE * std + 0.005::DOUBLE * rs')} AS std FROM mlong JOIN st USING (idx)""")
def scaler_ewma(spark, d):
    recent = X.scaling_stats(latest(flows.bout_features(spark, d), K.RECENT_FEATURES), skip_ages=False)
    df = tables.model_versions(spark, d).withColumn("_r", recent.scalar())
    out = M.explode_bundle(M.drift_scaler(df, F.col("_r")))
    return out.select("model_id", "idx", r6(F.col("mean")).alias("mean"), r6(F.col("std")).alias("std"))


_contrib = " UNION ALL ".join(f"SELECT bout_id, {i} AS idx, '{n}' AS name, {n} * ({flows.FIXED_WEIGHTS[i]})::DOUBLE AS value FROM feats" for i, n in enumerate(K.FEATURE_NAMES))


@query("contributions", Q.with_(["feats"], f"""SELECT bout_id, CAST(row_number() OVER (PARTITION BY bout_id ORDER BY abs(value) DESC, idx) AS INT) AS rank, name, {Q.r6('value')} AS value
  FROM ({_contrib}) WHERE abs(value) > 0.0001"""))
def contributions(spark, d):
    df = flows.bout_features(spark, d).select("bout_id", M.contributions(flows.FIXED_WEIGHTS).alias("c"))
    out = df.select("bout_id", F.posexplode_outer("c").alias("p", "c")).filter("p IS NOT NULL")
    return out.select("bout_id", (F.col("p") + 1).alias("rank"), F.col("c.name").alias("name"), r6(F.col("c.value")).alias("value"))


_scontrib = " UNION ALL ".join(
    f"SELECT bout_id, {i} AS idx, '{n}' AS name, {Q.scaled(i)} * ({flows.FIXED_WEIGHTS[i]})::DOUBLE * CASE WHEN proba_a > 0.5 THEN 1 ELSE -1 END AS push FROM raw" for i, n in enumerate(K.FEATURE_NAMES))
TOP3_SQL = f"SELECT bout_id, idx, name, push, row_number() OVER (PARTITION BY bout_id ORDER BY push DESC, idx) AS rn FROM ({_scontrib})"


def with_top3(spark, d, last: int | None = None):
    """Scored bouts, or the ``last`` of them, with ``top``: their three strongest contributors.  The scaling is that of all bouts."""
    feats = flows.bout_features(spark, d)
    scaling = materialize(X.scaling_stats(feats), "top3-scaling")
    df = flows.score(feats if last is None else latest(feats, last), scaling=scaling).withColumn("_s", scaling.scalar())
    scaled = X.zscored([F.get("_s.means", F.lit(j)) for j in range(K.WIDTH)], [F.get("_s.stds", F.lit(j)) for j in range(K.WIDTH)])
    names = [f"z{j}" for j in range(K.WIDTH)]
    df = df.select("*", F.when(F.col("proba_a") > 0.5, 1.0).otherwise(-1.0).alias("_sign"), *[c.alias(n) for c, n in zip(scaled, names)])
    return df.withColumn("top", M.top_contributors(names, flows.FIXED_WEIGHTS, "_sign")).drop("_s", "_sign", *names)


@query("top_contributors", Q.with_(["raw"], f"SELECT bout_id, CAST(rn AS INT) AS rank, name, {Q.r6('push')} AS push FROM ({TOP3_SQL}) WHERE rn <= 3"))
def top_contributors(spark, d):
    df = with_top3(spark, d).select("bout_id", F.posexplode_outer("top").alias("p", "c"))
    return df.select("bout_id", (F.col("p") + 1).alias("rank"), F.col("c.name").alias("name"), r6(-F.col("c.neg")).alias("push"))
