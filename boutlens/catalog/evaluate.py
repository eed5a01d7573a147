"""Verdicts, backtests, reports and training queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from boutlens import constants as K
from boutlens.catalog import query
from boutlens.catalog import sqlkit as Q
from boutlens.catalog.dataset import SAMPLE_SQL
from boutlens.catalog.models import TOP3_SQL, with_top3
from boutlens.functions.numbers import confidence_factor, r6
from boutlens.operators import dataset as DS
from boutlens.operators import evaluate as E
from boutlens.operators import features as X
from boutlens.operators import models as M
from boutlens.operators import records as R
from boutlens.operators import scoring as S
from boutlens.plans import flows, periods, training
from boutlens.session import materialize
from boutlens.sources import tables

MARKET = "CASE WHEN odds_a <= odds_b THEN fighter_a ELSE fighter_b END"
MARKET_DRAW = "CASE WHEN odds_a < odds_b THEN fighter_a WHEN odds_b < odds_a THEN fighter_b ELSE 'draw' END"


@query("arbitrage", Q.with_(["scored"], f"""SELECT bout_id, CASE WHEN m = o AND m = k THEN 'recommend' WHEN m = o THEN 'value' WHEN m = k THEN 'weak' ELSE 'skip' END AS verdict,
  CASE WHEN m = o AND m = k THEN 'max' WHEN m = o THEN 'high' WHEN m = k THEN 'medium' ELSE 'none' END AS confidence,
  CASE WHEN m = o AND m = k THEN 'all three agree' WHEN m = o THEN 'model and opinion against the market' WHEN m = k THEN 'opinion warns'
    WHEN o = k THEN 'opinion and market against the model' ELSE 'no consensus' END AS reason,
  CASE WHEN m = o AND m = k THEN 'recommend' WHEN m = o THEN 'value' ELSE 'other' END AS tier
  FROM (SELECT bout_id, pred_winner AS m, ai_winner AS o, {MARKET} AS k FROM scored)"""))
def arbitrage(spark, d):
    df = flows.scored_bouts(spark, d)
    market = S.market_favourite(F.col("odds_a"), F.col("odds_b"), F.col("fighter_a"), F.col("fighter_b"))
    return df.select("bout_id", *[c.alias(k) for k, c in S.arbitrage(F.col("pred_winner"), F.col("ai_winner"), market).items()])


@query("arbitrage_bridge", Q.with_(["scored"], f"""SELECT bout_id, CAST(x + y AS INT) AS agreements, CASE WHEN x + y = 2 THEN 'recommend' WHEN x + y = 1 THEN CASE WHEN x = 1 THEN 'value' ELSE 'weak' END
  WHEN prob > 0.60 THEN 'recommend' WHEN prob > 0.50 THEN 'weak' ELSE 'skip' END AS verdict FROM (SELECT bout_id, prob,
  CASE WHEN pred_winner = ai_winner THEN 1 ELSE 0 END AS x, CASE WHEN pred_winner = {MARKET_DRAW} THEN 1 ELSE 0 END AS y FROM scored)"""))
def arbitrage_bridge(spark, d):
    df = flows.scored_bouts(spark, d)
    market = S.market_favourite(F.col("odds_a"), F.col("odds_b"), F.col("fighter_a"), F.col("fighter_b"), tie="draw")
    return df.select("bout_id", *[c.alias(k) for k, c in S.arbitrage_bridge(F.col("pred_winner"), F.col("ai_winner"), market, F.col("prob")).items()])


_OPIN = {"winner": "CASE WHEN bout_id % 4 = 0 THEN 'The other one' WHEN bout_id % 4 = 1 THEN upper(ai_winner) ELSE 'My pick is ' || ai_winner END",
         "confidence": "CASE WHEN bout_id % 6 = 0 THEN 'high' ELSE CAST(bout_id * 13 % 130 AS VARCHAR(9)) || '.5' END",
         "reason": "repeat('because ' || bout_id || ' ', 60)"}


@query("opinion_clean", Q.with_(["bouts"], f"""SELECT bout_id, CASE WHEN contains(lower(w), lower(fighter_a)) OR contains(lower(w), lower(fighter_b)) THEN w ELSE 'unknown' END AS winner,
  CAST(greatest(55, least(92, coalesce(trunc(TRY_CAST(c AS DOUBLE)), 60))) AS INT) AS confidence, md5(substr(r, 1, 400)) AS reason_digest,
  CASE WHEN p IN ('X', 'Y') THEN p ELSE '' END AS pick, CAST(CASE WHEN p IN ('X', 'Y') THEN greatest(55, least(92, coalesce(trunc(TRY_CAST(c AS DOUBLE)), 60))) ELSE 50 END AS INT) AS conf
  FROM (SELECT bout_id, fighter_a, fighter_b, {_OPIN['winner']} AS w, {_OPIN['confidence']} AS c, {_OPIN['reason']} AS r, upper(trim(lower(coalesce(blind_pick, 'Z')) || ' ')) AS p FROM bouts)"""))
def opinion_clean(spark, d):
    df = tables.bouts(spark, d)
    answer = F.struct(*[F.expr(e).alias(k) for k, e in _OPIN.items()])
    df = df.withColumns({"ans": answer, "raw_pick": F.concat(F.lower(F.coalesce("blind_pick", F.lit("Z"))), F.lit(" "))})
    o = S.opinion_record(F.col("ans"), F.col("fighter_a"), F.col("fighter_b"))
    b = S.blind_record(F.col("raw_pick"), F.col("ans.confidence"))
    return df.select("bout_id", o["winner"].alias("winner"), o["confidence"].alias("confidence"), F.md5(o["reason"]).alias("reason_digest"),
                     F.coalesce(b["pick"], F.lit("")).alias("pick"), b["conf"].alias("conf"))


_tilt_pa = "CASE WHEN pred_side = 'a' THEN prob ELSE 1.0 - prob END"


@query("blind_tilt", Q.with_(["scored"], f"""SELECT bout_id, applies AS tilt_applied, side AS tilt_side, {Q.r6('p')} AS tilt_prob, CASE WHEN side <> pred_side THEN 1 ELSE 0 END AS tilt_flipped,
  {Q.r6('greatest(0.0, p - 0.15)')} AS tilt_ci_lo, {Q.r6('least(1.0, p + 0.15)')} AS tilt_ci_hi FROM (SELECT *, CASE WHEN applies = 1 THEN CASE WHEN moved >= 0.5 THEN 'a' ELSE 'b' END ELSE pred_side END AS side,
  CASE WHEN applies = 1 THEN greatest(moved, 1.0 - moved) ELSE prob END AS p FROM (SELECT *, greatest(0.10::DOUBLE, least(0.90::DOUBLE, {_tilt_pa} + CASE WHEN blind_pick = 'X' THEN 0.03::DOUBLE ELSE -0.03::DOUBLE END)) AS moved,
  CASE WHEN blind_pick IN ('X', 'Y') AND blind_conf >= 70 AND prob <= 0.53 THEN 1 ELSE 0 END AS applies FROM scored))"""))
def blind_tilt(spark, d):
    df = S.blind_tilt(flows.scored_bouts(spark, d))
    return df.select("bout_id", "tilt_applied", "tilt_side", "tilt_flipped", *[r6(F.col(c)).alias(c) for c in ("tilt_prob", "tilt_ci_lo", "tilt_ci_hi")])


FACTOR_SQL = "(CASE WHEN blind_pick IS NULL OR greatest(60, least(85, blind_conf)) < 70 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE + (greatest(60, least(85, blind_conf)) - 70) / 50.0::DOUBLE END)"


@query("sample_weights", Q.with_(["bouts"], f"SELECT bout_id, {Q.r6(f'1.2::DOUBLE * {FACTOR_SQL}')} AS fresh, {Q.r6(f'0.7::DOUBLE * {FACTOR_SQL}')} AS historical FROM bouts"))
def sample_weights(spark, d):
    factor = confidence_factor(F.when(F.col("blind_pick").isNotNull(), F.col("blind_conf")))
    return tables.bout_core(spark, d).select("bout_id", r6(S.sample_weight(F.lit(True), factor)).alias("fresh"), r6(S.sample_weight(F.lit(False), factor)).alias("historical"))


@query("agreement_factor", Q.with_(["bouts"], """SELECT bout_id, CASE WHEN blind_pick IS NULL THEN 1.0::DOUBLE WHEN CASE blind_pick WHEN 'X' THEN fighter_a ELSE fighter_b END = winner THEN 1.5::DOUBLE ELSE 0.5::DOUBLE END AS factor FROM bouts"""))
def agreement_factor(spark, d):
    pick = F.when(F.col("blind_pick") == "X", F.col("fighter_a")).when(F.col("blind_pick") == "Y", F.col("fighter_b"))
    return tables.bouts(spark, d).select("bout_id", S.agreement_factor(pick, F.col("winner")).alias("factor"))


@query("result_view", Q.with_(["scored"], f"""SELECT bout_id, round_even(prob * 100, 2) AS probability_percent,
  printf('%.1f%%', round_even(ci_lo * 100, 1)) || ' - ' || printf('%.1f%%', round_even(ci_hi * 100, 1)) AS interval_text,
  sa_wins || '-' || sa_losses || ', reach=' || sa_reach_cm || 'cm, camp=' || sa_camp_name AS record_a,
  sb_wins || '-' || sb_losses || ', reach=' || sb_reach_cm || 'cm, camp=' || sb_camp_name AS record_b,
  CASE WHEN {Q.is_stub('odds_a', 'odds_b')} THEN 'default odds' ELSE 'priced' END AS market_label FROM scored"""))
def result_view(spark, d):
    return S.result_view(flows.scored_bouts(spark, d)).select("bout_id", "probability_percent", "interval_text", "record_a", "record_b", "market_label")


_HIT = "CASE WHEN winner_side IS NOT NULL AND (proba_a > 0.5) = (winner_side = 'a') THEN 1 ELSE 0 END"


def _raw_hits(df):
    hit = F.coalesce(((F.col("proba_a") > 0.5) == (F.col("winner_side") == "a")).cast("int"), F.lit(0))
    return df.withColumn("correct", hit)


def _acc(h="sum(c)", n="count(*)"):
    return f"CAST({n} AS BIGINT) AS total, CAST({h} AS BIGINT) AS hits, {Q.r6(f'{h} * 100.0::DOUBLE / {n}')} AS accuracy"


@query("backtest_accuracy", Q.with_(["raw"], "").rstrip() + f""",
h AS MATERIALIZED (SELECT strftime(bout_date, '%Y') AS year, {_HIT} AS c, row_number() OVER (ORDER BY bout_date DESC, bout_id DESC) AS e FROM raw)
SELECT year AS scope, {_acc()} FROM h GROUP BY 1 UNION ALL SELECT 'all', {_acc()} FROM h UNION ALL SELECT 'slice', {_acc()} FROM h WHERE e BETWEEN 101 AND 200""")
def backtest_accuracy(spark, d):
    df = _raw_hits(flows.score(flows.bout_features(spark, d))).select("bout_id", "bout_date", "correct")
    by_year = df.withColumn("scope", F.date_format("bout_date", "yyyy")).rollup("scope").agg(F.count("*").alias("total"), F.sum("correct").alias("hits"))
    by_year = by_year.withColumn("scope", F.coalesce("scope", F.lit("all")))
    part = DS.eval_slice(df).agg(F.count("*").alias("total"), F.sum("correct").alias("hits")).withColumn("scope", F.lit("slice"))
    return by_year.unionByName(part).select("scope", "total", "hits", r6(E.rate(F.col("hits"), F.col("total"))).alias("accuracy"))


@query("confidence_buckets", Q.with_(["scored"], "").rstrip() + f""",
h AS MATERIALIZED (SELECT CASE WHEN greatest(proba_a, 1.0 - proba_a) >= 0.60 THEN 'confident' ELSE 'unsure' END AS bucket, CASE WHEN pred_winner = winner THEN 1 ELSE 0 END AS c FROM scored)
SELECT bucket, {_acc()} FROM h GROUP BY 1 UNION ALL SELECT 'all', {_acc()} FROM h""")
def confidence_buckets(spark, d):
    df = flows.scored_bouts(spark, d)
    df = df.withColumn("correct", F.coalesce((F.col("pred_winner") == F.col("winner")).cast("int"), F.lit(0)))
    out = E.confidence_buckets(df)
    return out.select("bucket", "total", "hits", r6(F.col("accuracy")).alias("accuracy"))


@query("session_summary", Q.with_(["scored"], f"""SELECT count(*) AS total, count(*) FILTER (WHERE pred_winner = winner) AS correct, count(*) FILTER (WHERE pred_winner <> winner) AS incorrect,
  count(*) FILTER (WHERE winner IS NULL) AS errors, count(*) FILTER (WHERE winner IS NOT NULL AND blind_pick IS NOT NULL) AS answered,
  count(*) FILTER (WHERE CASE blind_pick WHEN 'X' THEN fighter_a WHEN 'Y' THEN fighter_b END = winner) AS agree,
  {Q.r6('count(*) FILTER (WHERE pred_winner = winner) * 100.0::DOUBLE / count(winner)')} AS accuracy,
  {Q.r6("count(*) FILTER (WHERE CASE blind_pick WHEN 'X' THEN fighter_a WHEN 'Y' THEN fighter_b END = winner) * 100.0::DOUBLE / count(*) FILTER (WHERE winner IS NOT NULL AND blind_pick IS NOT NULL)")} AS blind_accuracy FROM scored"""))
def session_summary(spark, d):
    out = E.session_summary(flows.scored_bouts(spark, d))
    return out.withColumns({c: r6(F.col(c)) for c in ("accuracy", "blind_accuracy")})


@query("batch_report", Q.with_(["raw"], "").rstrip() + f""",
t AS (SELECT bout_id, string_agg(name, ',' ORDER BY rn) AS top FROM ({TOP3_SQL}) WHERE rn <= 3 GROUP BY 1)
SELECT r.bout_id, top, CASE WHEN proba_a > 0.5 THEN fighter_a ELSE fighter_b END AS predicted, {_HIT} AS hit
FROM (SELECT *, row_number() OVER (ORDER BY bout_date DESC, bout_id DESC) AS e FROM raw) r JOIN t USING (bout_id) WHERE e <= 150""")
def batch_report(spark, d):
    df = _raw_hits(with_top3(spark, d, K.BATCH_TRAIN_SIZE))
    return df.select("bout_id", F.array_join("top.name", ",").alias("top"),
                     F.when(F.col("proba_a") > 0.5, F.col("fighter_a")).otherwise(F.col("fighter_b")).alias("predicted"), F.col("correct").alias("hit"))


def _neutral(spark, d):
    """Backtests predict without a market: both odds at the stub value."""
    df = flows.score(flows.bout_features(spark, d)).withColumns({"n_a": F.lit(K.STUB_ODDS), "n_b": F.lit(K.STUB_ODDS)})
    out = S.final_prediction(df, odds=("n_a", "n_b"))
    return out.withColumn("correct", F.coalesce((F.col("pred_winner") == F.col("winner")).cast("int"), F.lit(0)))


@query("backtest_card", Q.with_(["blindscored"], f"""SELECT strftime(bout_date, '%Y-%m-%d') AS card, {_acc()} FROM (SELECT bout_date, CASE WHEN pred_winner = winner THEN 1 ELSE 0 END AS c,
  row_number() OVER (PARTITION BY bout_date ORDER BY bout_id) AS rn FROM blindscored) WHERE rn IN (1, 2, 4) GROUP BY 1"""))
def backtest_card(spark, d):
    df = DS.pick_positions(_neutral(spark, d).select("bout_id", "bout_date", "correct"), "bout_date", "bout_id", [0, 1, 3])
    out = E.hit_counts(df, ["bout_date"])
    return out.select(F.date_format("bout_date", "yyyy-MM-dd").alias("card"), "total", "hits", r6(F.col("accuracy")).alias("accuracy"))


_PER = f"""
w0 AS (SELECT {Q.lst(flows.FIXED_WEIGHTS)} AS w, [{', '.join(f'd{j}' for j in range(K.WIDTH))}] AS sd FROM scaling),
per AS (SELECT period, min(seq) AS start, count(*) AS n FROM (SELECT strftime(bout_date, '%Y-%m') AS period, row_number() OVER (ORDER BY bout_date, bout_id) AS seq FROM feats) GROUP BY 1),
placed AS MATERIALIZED (SELECT f.*, per.period, seq, n, (seq - start) // {K.BATCH_TRAIN_SIZE} AS batch,
  {FACTOR_SQL.replace('blind_', 'f.blind_')} AS factor, CASE WHEN winner_side = 'a' THEN 1 ELSE 0 END AS label
  FROM (SELECT *, row_number() OVER (ORDER BY bout_date, bout_id) AS seq FROM feats) f JOIN per ON per.period = strftime(bout_date, '%Y-%m')),
hd AS (SELECT period, batch, start - 1 + {K.BATCH_TRAIN_SIZE} * (batch + 1) - {K.RECENT_WINDOW} AS h FROM (SELECT *, unnest(range(n // {K.BATCH_TRAIN_SIZE})) AS batch FROM per)),
tick AS (SELECT *, ('0x' || substr(md5('{K.TRAIN_SEED}|' || period || '|' || batch || '|' || i), 1, 13))::BIGINT AS t
  FROM (SELECT *, unnest(CASE WHEN h > {periods.SORTED} THEN range({periods.DRAWS}) ELSE range(1, h + 1) END) AS i FROM hd WHERE h > 0)),
drawn AS (SELECT period, batch, seq FROM (SELECT period, batch, seq, row_number() OVER (PARTITION BY period, batch ORDER BY k, seq) AS rn FROM
  (SELECT period, batch, CASE WHEN h > {periods.SORTED} THEN t % h + 1 ELSE i END AS seq, min(CASE WHEN h > {periods.SORTED} THEN i ELSE t END) AS k FROM tick GROUP BY ALL)) WHERE rn <= {K.HISTORICAL_TARGET}),
tr AS MATERIALIZED (SELECT period, batch, {K.FRESH_WEIGHT}::DOUBLE * factor AS sw, label, {', '.join(K.FEATURE_NAMES)} FROM placed WHERE batch < n // {K.BATCH_TRAIN_SIZE}
  UNION ALL SELECT d.period, d.batch, {K.HISTORICAL_WEIGHT}::DOUBLE * factor, label, {', '.join(K.FEATURE_NAMES)} FROM drawn d JOIN placed USING (seq)),
zst AS (SELECT period, batch, {', '.join(f'avg({n}) AS m{j}, greatest(stddev_pop({n}), 1e-8::DOUBLE) AS d{j}' for j, n in enumerate(K.FEATURE_NAMES))} FROM tr GROUP BY ALL),
zs AS MATERIALIZED (SELECT period, batch, sw, label, [{', '.join(f'CAST({n} AS DOUBLE)' if j in K.UNSCALED else f'({n} - m{j}) / d{j}' for j, n in enumerate(K.FEATURE_NAMES))}] AS z FROM tr JOIN zst USING (period, batch)),
mask AS MATERIALIZED (SELECT ep, list_transform(range({K.WIDTH}), lambda j: ('0x' || substr(md5('{K.TRAIN_SEED}|' || ep || '|' || j), 1, 8))::BIGINT / 4294967296.0::DOUBLE > {K.BASE_DROPOUT}::DOUBLE) AS keep FROM (SELECT unnest(range({K.EPOCHS})) AS ep))"""


def _each(fn, over: str = "w") -> str:
    """A list built from its elements w[j], one expression per feature."""
    return "[" + ", ".join(fn(j, f"{over}[{j + 1}]") for j in range(K.WIDTH)) + "]"


def _moved(j: int, w: str) -> str:
    lr, decay = f"{K.LEARNING_RATE}::DOUBLE", f"{K.ALPHA}::DOUBLE * (1 - {K.L1_RATIO}::DOUBLE)"
    if j in K.NO_DECAY:
        out = f"{w} - {lr} * g[{j + 1}]"
    else:
        out = f"{w} - {lr} * (g[{j + 1}] + {decay} * {w})"
        zone = f"{K.DEAD_ZONE}::DOUBLE"
        out = f"CASE WHEN abs({out}) < {zone} THEN CASE WHEN {out} >= 0 THEN {zone} ELSE -{zone} END ELSE {out} END"
    out = f"CASE WHEN keep[{j + 1}] THEN {out} ELSE {w} END"
    if j in K.POSITIVE_ONLY:
        out = f"greatest({out}, {K.POSITIVE_FLOOR}::DOUBLE)"
    if j == 10:
        out = f"greatest({out}, {-K.NAMED_LIMITS[10]}::DOUBLE)"
    if j == 32:
        out = f"greatest({-K.NAMED_LIMITS[32]}::DOUBLE, least({K.NAMED_LIMITS[32]}::DOUBLE, {out}))"
    return out


def _guarded(j: int, w: str) -> str:
    old, sd = f"old[{j + 1}]", f"sd[{j + 1}]"
    half = f"CASE WHEN abs({w} - {old}) > {K.STEP_MIN}::DOUBLE THEN {old} + ({w} - {old}) * {K.STEP_SHARE}::DOUBLE ELSE {old} END"
    spread = f"{K.ADAPTIVE_CLIP}::DOUBLE / (CASE WHEN {sd} < 1e-8 THEN 1.0::DOUBLE ELSE {sd} END + 1e-8::DOUBLE)"
    out = f"greatest(-({spread}), least({spread}, {half}))"
    for limit in [M._LIMITS[j]] if j in M._LIMITS else []:
        out = f"greatest({-limit}::DOUBLE, least({limit}::DOUBLE, {out}))"
    if j in M._FLOORS:
        out = f"greatest({M._FLOORS[j]}::DOUBLE, {out})"
    return f"greatest({-K.AGE_LIMIT}::DOUBLE, least({K.AGE_LIMIT}::DOUBLE, {out}))" if j in K.UNSCALED else out


def _lifted(j: int, w: str) -> str:
    return f"CASE WHEN abs({w}) < lift THEN CASE WHEN {w} >= 0 THEN lift ELSE -lift END ELSE {w} END"


def _paired(j: int, w: str) -> str:
    if j not in M._PARTNER:
        return w
    bound, other = f"{M._PAIR_BOUND[j]}::DOUBLE", f"w[{M._PARTNER[j] + 1}]"
    clip = lambda x: f"greatest(-{bound}, least({bound}, {x}))"
    small = clip(f"{w} * ({bound} / greatest(abs({w}), abs({other})))")
    return f"CASE WHEN abs({w}) <= {bound} THEN {w} WHEN abs({other}) <= {bound} THEN {clip(w)} WHEN abs({w} - {small}) > 0.0001 THEN {small} ELSE {w} END"


#: one step per epoch; the last one of a batch also makes the guarded half step from the weights that the batch began with
PREQUENTIAL_SQL = Q.with_(["scaling"], "").rstrip().replace("WITH ", "WITH RECURSIVE ", 1) + "," + _PER + f""",
rec(period, batch, ep, old, w, b) AS (SELECT period, 0::BIGINT, 0::BIGINT, w, w, {flows.FIXED_BIAS}::DOUBLE FROM per, w0
  UNION ALL
  SELECT period, batch + fin, CASE WHEN fin = 1 THEN 0 ELSE ep + 1 END, CASE WHEN fin = 1 THEN done ELSE old END, CASE WHEN fin = 1 THEN done ELSE w END,
    CASE WHEN fin = 1 THEN CASE WHEN abs(b) <= {K.BIAS_RESET} THEN greatest({-K.BIAS_LIMIT}::DOUBLE, least({K.BIAS_LIMIT}::DOUBLE, b)) ELSE 0 END ELSE b END
  FROM (SELECT period, batch, ep, fin, old, raw AS w, b, {_each(_paired)} AS done FROM
   (SELECT *, w AS raw_, {_each(_lifted)} AS w2 FROM
    (SELECT *, greatest(list_sum(list_transform(w, lambda x: abs(x))) / {K.WIDTH} * 0.01, 0.00001::DOUBLE) AS lift FROM
     (SELECT period, batch, ep, fin, old, w AS raw, b, {_each(_guarded)} AS w FROM
      (SELECT period, batch, ep, CASE WHEN ep = {K.EPOCHS - 1} THEN 1 ELSE 0 END AS fin, old, sd, {_each(_moved)} AS w, b - {K.LEARNING_RATE}::DOUBLE * se AS b FROM
       (SELECT period, batch, ep, any_value(old) AS old, any_value(w) AS w, any_value(b) AS b, sum(e) / count(*) AS se, {_each(lambda j, z: f'sum(e * {z}) / count(*)', 'z')} AS g FROM
        (SELECT rec.*, z, (1.0 / (1.0 + exp(-greatest(-500.0::DOUBLE, least(500.0::DOUBLE, list_dot_product(z, w) + b)))) - label) * sw AS e FROM rec JOIN zs USING (period, batch)) GROUP BY period, batch, ep)
       JOIN mask USING (ep), (SELECT sd FROM w0)))))
    t(period, batch, ep, fin, old, raw, b, before, lift, raw_, w)))
SELECT period AS month, batch, CAST(count(*) AS BIGINT) AS total, CAST(sum(c) AS BIGINT) AS hits, {Q.r6('sum(c) * 100.0::DOUBLE / count(*)')} AS accuracy, {Q.r6('max(size)')} AS weight_sum
FROM (SELECT period, batch, list_sum(list_transform(w, lambda x: abs(x))) AS size, CASE WHEN winner_side IS NOT NULL AND
  ({' + '.join(f'{Q.scaled(j)} * w[{j + 1}]' for j in range(K.WIDTH))} + b > 0) = (winner_side = 'a') THEN 1 ELSE 0 END AS c
  FROM placed JOIN scaling ON true JOIN rec USING (period, batch) WHERE ep = 0) GROUP BY ALL"""


@query("prequential_eval", PREQUENTIAL_SQL)
def prequential_eval(spark, d):
    """Every month from the stored model: each batch of 150 is scored with the weights that the batch before left."""
    rows, models = periods.train_periods(flows.bout_features(spark, d), fixed_model(spark, d))
    sizes = models.select("period", "batch", F.aggregate("weights", F.lit(0.0), lambda s, w: s + F.abs(w)).alias("weight_sum"))
    out = E.hit_counts(_raw_hits(rows), ["period", "batch"]).join(sizes, ["period", "batch"])
    return out.select(F.col("period").alias("month"), "batch", "total", "hits", r6(F.col("accuracy")).alias("accuracy"), r6(F.col("weight_sum")).alias("weight_sum"))


def _filled(s: str) -> dict[str, str]:
    """SQL for the six fields of a side after imputation: its own value, or the source's where that is empty."""
    gap = {k: f"(b.s{s}_{k} IS NULL{'' if k in ('dob', 'camp_name') else f' OR b.s{s}_{k} = 0'})" for k in K.IMPUTE_KEYS}
    return {k: f"CASE WHEN {g} THEN coalesce(p{s}.{k}, b.s{s}_{k}) ELSE b.s{s}_{k} END" for k, g in gap.items()} | {
        "filled": "coalesce(array_to_string([" + ", ".join(f"CASE WHEN {g} AND p{s}.{k} IS NOT NULL THEN '{k}' END" for k, g in sorted(gap.items(), key=lambda x: flows.SIDE_STATS.index(x[0]))) + "], ','), '')",
        "filled_as_of": f"CASE WHEN {' OR '.join(f'({g} AND p{s}.{k} IS NOT NULL)' for k, g in gap.items())} THEN p{s}.day END"}


def _imputed_features() -> str:
    """SQL that puts the imputed fields into the features that use them."""
    new = {}
    for s in "ab":
        new[f"{s}_exp"] = f"CAST(i{s}_exp AS DOUBLE)"
        new |= {f"{s}_{m}": f"CASE WHEN i{s}_dob_quality > 0 THEN CAST(s{s}_{m} AS DOUBLE) ELSE 0.5::DOUBLE END" for m in ("mystic_factor", "mystic_v2")}
        new |= {K.FEATURE_NAMES[i + (2 if s == "b" else 0)]: f"CAST(i{s}_{c} AS DOUBLE) / 200.0::DOUBLE" for i, c in ((38 + 0, "reach_cm"), (38 + 1, "height_cm"))}
    new[K.FEATURE_NAMES[36]] = "a_months_off / 12.0::DOUBLE * ia_exp"
    return ", ".join(f"{x} AS {n}" for n, x in new.items())


BATCH_CTES = Q.with_(["feats", "profiles"], "").rstrip() + f""",
{SAMPLE_SQL},
picked AS (SELECT f.*, is_fresh FROM sample JOIN feats f USING (bout_id)),
known AS (SELECT b.*, {', '.join(f'{x} AS i{s}_{k}' for s in 'ab' for k, x in _filled(s).items())} FROM picked b
  ASOF LEFT JOIN profiles pa ON pa.fid = b.a_id AND pa.day <= b.bout_date - 1 ASOF LEFT JOIN profiles pb ON pb.fid = b.b_id AND pb.day <= b.bout_date - 1),
batch AS MATERIALIZED (SELECT * REPLACE ({_imputed_features()}), CASE WHEN winner_side = 'a' THEN 1 ELSE 0 END AS label,
  CASE WHEN is_fresh = 1 THEN 1.2::DOUBLE ELSE 0.7::DOUBLE END * {FACTOR_SQL} AS sample_weight FROM known)"""


def _batch(spark, d):
    feats = flows.bout_features(spark, d)
    return training.training_batch(feats, feats.filter("held_out = 1"), pending=100, enrich=R.from_snapshots(tables.profiles(spark, d)))


_BATCH_SHOWN = ["sample_weight", "a_fin_rate", "b_age", "a_exp", "b_exp", "a_mystic_factor", "b_mystic_v2", K.FEATURE_NAMES[36], *K.FEATURE_NAMES[38:42]]


@query("training_batch", BATCH_CTES + f" SELECT bout_id, is_fresh, label, ia_filled AS filled_a, ib_filled AS filled_b, coalesce(strftime(ia_filled_as_of, '%Y-%m-%d'), '') AS as_of_a, "
       + ", ".join(f"{Q.r6(c)} AS {c}" for c in _BATCH_SHOWN) + " FROM batch")
def training_batch(spark, d):
    a, b = F.col("stats_a"), F.col("stats_b")
    return _batch(spark, d).select("bout_id", "is_fresh", "label", F.array_join(a["filled"], ",").alias("filled_a"), F.array_join(b["filled"], ",").alias("filled_b"),
                                   F.coalesce(F.date_format(a["filled_as_of"], "yyyy-MM-dd"), F.lit("")).alias("as_of_a"), *[r6(F.col(c)).alias(c) for c in _BATCH_SHOWN])


_GZ = [n if i in K.UNSCALED else f"(({n} - m{i}) / d{i})" for i, n in enumerate(K.FEATURE_NAMES)]
_GP = "1.0 / (1.0 + exp(-(" + " + ".join(f"{z} * ({w})::DOUBLE" for z, w in zip(_GZ, flows.FIXED_WEIGHTS)) + f" + {flows.FIXED_BIAS}::DOUBLE)))"


@query("gradient_step", BATCH_CTES + f""", bs AS MATERIALIZED ({Q.scaling_select(True, 'batch')}),
e AS MATERIALIZED (SELECT *, ({_GP} - label) * sample_weight AS err FROM batch, bs)
""" + " UNION ALL ".join(f"SELECT {i} AS idx, '{n}' AS name, {Q.r6(f'sum(err * {z}) / count(*)')} AS gradient FROM e" for i, (n, z) in enumerate(zip(K.FEATURE_NAMES, _GZ)))
       + f" UNION ALL SELECT 46, 'bias', {Q.r6('sum(err) / count(*)')} FROM e")
def gradient_step(spark, d):
    batch = materialize(_batch(spark, d), "batch")
    g = training.gradient(training.scaled_batch(batch, X.scaling_stats(batch, batch=True)), flows.FIXED_WEIGHTS, flows.FIXED_BIAS)
    names = F.array(*[F.lit(n) for n in [*K.FEATURE_NAMES, "bias"]])
    values = F.concat("gradient", F.array("error"))
    out = g.select(F.posexplode_outer(F.arrays_zip(names.alias("name"), values.alias("g"))).alias("idx", "z"))
    return out.select("idx", F.col("z.name").alias("name"), r6(F.col("z.g")).alias("gradient"))


def fixed_model(spark, d):
    """One row (model_id, weights, bias, means, stds): the fixed weights with the scaling of all bouts."""
    scaling = X.scaling_stats(flows.bout_features(spark, d))
    weights = F.array(*[F.lit(float(w)) for w in flows.FIXED_WEIGHTS])
    return scaling.select(F.lit(0).alias("model_id"), weights.alias("weights"), F.lit(flows.FIXED_BIAS).alias("bias"), "scaling.means", "scaling.stds")


@query("fit_model")
def fit_model(spark, d):
    """100 epochs on the training batch, then the guarded half step.  Iterative, so rows only."""
    feats = flows.bout_features(spark, d)
    out = training.train_incremental(feats, feats.filter("held_out = 1"), materialize(fixed_model(spark, d), "model"), pending=100, best_accuracy=0.5)
    names = F.array(*[F.lit(n) for n in K.FEATURE_NAMES])
    out = out.select("bias", "accuracy", F.col("promoted").cast("int").alias("promoted"), F.posexplode_outer(F.arrays_zip(names.alias("name"), F.col("weights").alias("weight"))).alias("idx", "z"))
    return out.select("idx", "z.name", "z.weight", "bias", "accuracy", "promoted")


@query("wrong_predictions", Q.with_(["scored"], "SELECT bout_id, fighter_a, fighter_b, pred_winner AS predicted, winner AS fact FROM scored WHERE pred_winner <> winner"))
def wrong_predictions(spark, d):
    return E.wrong_predictions(flows.scored_bouts(spark, d)).select("bout_id", "fighter_a", "fighter_b", "predicted", "fact")


@query("batch_composition", BATCH_CTES + f""" SELECT count(*) AS total, count(*) FILTER (WHERE is_fresh = 1) AS fresh, count(*) FILTER (WHERE is_fresh = 0) AS historical,
  count(*) FILTER (WHERE sample_weight > CASE WHEN is_fresh = 1 THEN {K.FRESH_WEIGHT}::DOUBLE ELSE {K.HISTORICAL_WEIGHT}::DOUBLE END + 1e-9::DOUBLE) AS up_weighted FROM batch""")
def batch_composition(spark, d):
    return E.batch_composition(_batch(spark, d), K.FRESH_WEIGHT, K.HISTORICAL_WEIGHT)
