"""History, features, scoring and verdict queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from boutlens import constants as K
from boutlens.catalog import query
from boutlens.catalog.sqlkit import Z, is_stub, implied, lst, r6 as q6, scaled, scaling_select, with_
from boutlens.functions.numbers import implied_prob, is_stub as stub, r6
from boutlens.operators import features as X
from boutlens.operators import scoring as S
from boutlens.plans import flows
from boutlens.sources import tables


def _hist(name: str, columns: list[str], sql_columns: list[str] | None = None):
    cols = ", ".join(sql_columns or columns)

    def run(spark, d):
        df = flows.side_history(spark, d)
        return df.select("bout_id", "fid", *[r6(F.col(c)).alias(c) if c.endswith("rate") else F.col(c) for c in columns])

    query(name, with_(["hist"], f"SELECT bout_id, fid, {cols} FROM hist"))(run)


_hist("pit_recent_wins", ["recent_wins"])
_hist("pit_form", ["form"])
_hist("pit_record", ["wins", "losses", "exp", "bouts_before"])
_hist("pit_months_off", ["months_off", "days_off"])
_hist("pit_fights_12m", ["fights_12m"])
_hist("pit_rates", ["fin_rate", "sub_rate"], [f"{q6('fin_rate')} AS fin_rate", f"{q6('sub_rate')} AS sub_rate"])


@query("feature_vector", with_(["feats"], "SELECT bout_id, " + ", ".join(f"{q6(n)} AS {n}" for n in K.FEATURE_NAMES) + " FROM feats"))
def feature_vector(spark, d):
    df = flows.bout_features(spark, d)
    return df.select("bout_id", *[r6(F.col(n)).alias(n) for n in K.FEATURE_NAMES])


def _scaling_sql(batch: bool) -> str:
    src = "scaling" if not batch else "(" + scaling_select(True) + ")"
    body = " UNION ALL ".join(
        f"SELECT {i} AS idx, '{n}' AS name, {q6(f'm{i}')} AS mean, {q6(f'd{i}')} AS std FROM s" for i, n in enumerate(K.FEATURE_NAMES))
    return with_(["scaling"], "").rstrip() + f",\ns AS MATERIALIZED (SELECT * FROM {src})\n{body}"


def _scaling_rows(spark, d, batch):
    stats = X.scaling_stats(flows.bout_features(spark, d), batch=batch)
    named = F.arrays_zip(F.array(*[F.lit(n) for n in K.FEATURE_NAMES]).alias("name"),
                         F.col("scaling.means").alias("mean"), F.col("scaling.stds").alias("std"))
    out = stats.select(F.posexplode_outer(named).alias("idx", "z"))
    return out.select("idx", F.col("z.name").alias("name"), r6(F.col("z.mean")).alias("mean"), r6(F.col("z.std")).alias("std"))


query("feature_stats", _scaling_sql(False))(lambda spark, d: _scaling_rows(spark, d, False))
query("feature_stats_batch", _scaling_sql(True))(lambda spark, d: _scaling_rows(spark, d, True))


@query("zscore", with_(["feats", "scaling"], "SELECT bout_id, " + ", ".join(
    f"{q6(scaled(i))} AS {n}" for i, n in enumerate(K.FEATURE_NAMES)) + " FROM feats, scaling"))
def zscore(spark, d):
    df = flows.bout_features(spark, d)
    df = df.withColumn("_s", X.scaling_stats(df).scalar())
    means = [F.get(F.col("_s.means"), F.lit(j)) for j in range(K.WIDTH)]
    stds = [F.get(F.col("_s.stds"), F.lit(j)) for j in range(K.WIDTH)]
    return df.select("bout_id", *[r6(c).alias(n) for c, n in zip(X.zscored(means, stds), K.FEATURE_NAMES)])


@query("score_raw", with_(["raw"], f"SELECT bout_id, {q6('proba_a')} AS proba_a FROM raw"))
def score_raw(spark, d):
    return flows.score(flows.bout_features(spark, d)).select("bout_id", r6(F.col("proba_a")).alias("proba_a"))


_SCORED = ["bout_id", "fighter_a", "fighter_b", "pred_winner", "pred_method", "pred_round", "pred_odds", "high_dispersion"]
_SCORED6 = ["proba_a", "prob", "ci_lo", "ci_hi"]


@query("score_bouts", with_(["scored"], "SELECT " + ", ".join(_SCORED) + ", " + ", ".join(f"{q6(c)} AS {c}" for c in _SCORED6) + " FROM scored"))
def score_bouts(spark, d):
    df = flows.scored_bouts(spark, d)
    return df.select(*_SCORED, *[r6(F.col(c)).alias(c) for c in _SCORED6])


@query("implied_prob", with_(["bouts"], f"""SELECT bout_id, CASE WHEN {is_stub('odds_a', 'odds_b')} THEN 1 ELSE 0 END AS is_stub,
  {q6(implied('odds_a'))} AS implied_a, {q6(implied('odds_b'))} AS implied_b FROM bouts"""))
def implied_query(spark, d):
    a, b = F.col("odds_a"), F.col("odds_b")
    return tables.bout_core(spark, d).select(
        "bout_id", stub(a, b).cast("int").alias("is_stub"), r6(implied_prob(a)).alias("implied_a"), r6(implied_prob(b)).alias("implied_b"))
