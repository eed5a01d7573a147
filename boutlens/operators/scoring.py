"""Scoring: probability, final prediction, market and second-opinion rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutlens import constants as K
from boutlens.functions.numbers import clamp, implied_prob, is_stub, safe_int
from boutlens.operators.features import zscored


def sigmoid(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-clamp(z, -500.0, 500.0)))


def linear(terms: list[Column], weights: list, bias) -> Column:
    """w.x + b unrolled into one expression, so that it is compiled, not interpreted per element."""
    return reduce(lambda s, t: s + t, [t * w for t, w in zip(terms, weights)]) + bias


def predict_proba(weights: list, bias, means: list, stds: list) -> Column:
    """Probability that side A wins, over the 46 feature columns of the frame."""
    return sigmoid(linear(zscored(means, stds), weights, bias))


def final_prediction(df: DataFrame, proba: str = "proba_a", odds: tuple[str, str] = ("odds_a", "odds_b")) -> DataFrame:
    """Damped and market-adjusted prediction.

    Needs fighter_a, fighter_b, rounds, stats_a, stats_b.  A probability of exactly
    one half goes to side B.  The round rule has no first-round outcome: the test for
    more than .65 comes before the one for more than .75.
    """
    oa, ob = F.col(odds[0]), F.col(odds[1])
    damped = 0.5 + (F.col(proba) - 0.5) * K.DAMPING
    pulled = clamp(damped - (damped - implied_prob(oa)) * K.MARKET_PULL, 0.30, 0.90)
    df = df.withColumn("final_a", F.when(is_stub(oa, ob), damped).otherwise(pulled))
    a_side = F.col("final_a") > 0.5
    df = df.withColumns({
        "pred_side": F.when(a_side, "a").otherwise("b"),
        "pred_winner": F.when(a_side, F.col("fighter_a")).otherwise(F.col("fighter_b")),
        "prob": F.when(a_side, F.col("final_a")).otherwise(1.0 - F.col("final_a"))})

    def of(mine: str, other: str, field: str) -> Column:
        return F.when(F.col("pred_side") == "a", F.col(f"stats_{mine}")[field]).otherwise(F.col(f"stats_{other}")[field])

    sub, fin, guard = of("a", "b", "sub_rate"), of("a", "b", "fin_rate"), of("b", "a", "td_def")
    prob = F.col("prob")
    method = (F.when((sub > 0.35) & (guard < 0.65), "SUBMISSION")
              .when((fin > 0.75) & (prob > 0.65), "KO")
              .when((fin > 0.60) & (prob > 0.55), "TKO")
              .when(prob <= 0.58, "DECISION_SPLIT")
              .otherwise("DECISION_UNANIMOUS"))
    df = df.withColumn("pred_method", method)
    early = F.least(F.when(prob > 0.65, 3).otherwise(2), F.col("rounds"))
    return df.withColumns({
        "pred_round": F.when(F.col("pred_method").isin(K.DECISIONS), F.col("rounds")).otherwise(early),
        "ci_lo": F.greatest(F.lit(0.0), prob - K.CI_HALF_WIDTH),
        "ci_hi": F.least(F.lit(1.0), prob + K.CI_HALF_WIDTH),
        "pred_odds": F.when(F.col("pred_side") == "a", oa).otherwise(ob),
        "high_dispersion": prob.between(0.45, 0.55).cast("int")})


def market_favourite(odds_a: Column, odds_b: Column, a: Column, b: Column, tie: str = "a") -> Column:
    """Lower odds; equal odds give side A, or ``draw`` with ``tie='draw'``."""
    if tie == "draw":
        return F.when(odds_a < odds_b, a).when(odds_b < odds_a, b).otherwise(F.lit("draw"))
    return F.when(odds_a <= odds_b, a).otherwise(b)


def arbitrage(model: Column, opinion: Column, market: Column) -> dict[str, Column]:
    """Three-way vote; the model alone against two others, or no majority, means skip."""
    both = model == opinion
    verdict = (F.when(both & (model == market), "recommend").when(both, "value")
               .when(model == market, "weak").otherwise("skip"))
    level = (F.when(both & (model == market), "max").when(both, "high")
             .when(model == market, "medium").otherwise("none"))
    reason = (F.when(both & (model == market), "all three agree")
              .when(both, "model and opinion against the market")
              .when(model == market, "opinion warns")
              .when(opinion == market, "opinion and market against the model")
              .otherwise("no consensus"))
    tier = F.when(verdict == "recommend", "recommend").when(verdict == "value", "value").otherwise("other")
    return {"verdict": verdict, "confidence": level, "reason": reason, "tier": tier}


def arbitrage_bridge(model: Column, opinion: Column, market: Column, prob: Column) -> dict[str, Column]:
    """Vote by the number of agreements; with none the probability decides."""
    agreements = (model == opinion).cast("int") + (model == market).cast("int")
    verdict = (F.when(agreements == 2, "recommend")
               .when(agreements == 1, F.when(model == opinion, "value").otherwise("weak"))
               .when(prob > 0.60, "recommend").when(prob > 0.50, "weak").otherwise("skip"))
    return {"agreements": agreements, "verdict": verdict}


def blind_tilt(df: DataFrame) -> DataFrame:
    """Shift an uncertain prediction towards a confident blind pick (X is side A, Y side B)."""
    active = (F.col("blind_pick").isin("X", "Y") & (F.col("blind_conf") >= K.TILT_MIN_CONF)
              & (F.col("prob") <= K.TILT_ZONE))
    p_a = F.when(F.col("pred_side") == "a", F.col("prob")).otherwise(1.0 - F.col("prob"))
    moved = clamp(p_a + F.when(F.col("blind_pick") == "X", F.lit(K.TILT)).otherwise(F.lit(-K.TILT)), 0.10, 0.90)
    applies = F.coalesce(active, F.lit(False))
    side = F.when(applies, F.when(moved >= 0.5, "a").otherwise("b")).otherwise(F.col("pred_side"))
    prob = F.when(applies, F.greatest(moved, 1.0 - moved)).otherwise(F.col("prob"))
    out = df.withColumns({"tilt_side": side, "tilt_prob": prob, "tilt_applied": applies.cast("int")})
    return out.withColumns({
        "tilt_flipped": (F.col("tilt_side") != F.col("pred_side")).cast("int"),
        "tilt_ci_lo": F.greatest(F.lit(0.0), F.col("tilt_prob") - K.CI_HALF_WIDTH),
        "tilt_ci_hi": F.least(F.lit(1.0), F.col("tilt_prob") + K.CI_HALF_WIDTH)})


def fold_scaling(scaling: DataFrame, weights: list[float], bias: float) -> DataFrame:
    """One row ``model`` struct(c0..c45, intercept): the z-scores folded into the weights.

    w.(x - m)/s + b is x.(w/s) + (b - w.m/s), so scoring a bout is 46 products and
    needs no statistics per feature.
    """
    coef, shift = [], F.lit(float(bias))
    for j, w in enumerate(weights):
        if j in K.UNSCALED:
            coef.append(F.lit(float(w)))
            continue
        sd = F.get("scaling.stds", F.lit(j))
        c = F.lit(float(w)) / F.when(sd <= 1e-12, F.lit(1.0)).otherwise(sd)
        coef.append(c)
        shift = shift - c * F.get("scaling.means", F.lit(j))
    return scaling.select(F.struct(*[c.alias(f"c{j}") for j, c in enumerate(coef)], shift.alias("intercept")).alias("model"))


def opinion_record(answer: Column, a: Column, b: Column) -> dict[str, Column]:
    """Clean a named opinion: winner must mention a side, confidence 55-92, reason up to 400 characters."""
    winner = F.coalesce(answer["winner"], F.lit(""))
    named = F.contains(F.lower(winner), F.lower(a)) | F.contains(F.lower(winner), F.lower(b))
    return {
        "winner": F.when(named, winner).otherwise(F.lit("unknown")),
        "confidence": clamp(safe_int(answer["confidence"], 60), 55, 92),
        "reason": F.substring(F.coalesce(answer["reason"], F.lit("no reason")), 1, 400),
    }


def blind_record(pick: Column, conf: Column) -> dict[str, Column]:
    """Clean a blind pick: X or Y with confidence 55-92, anything else is no pick at 50."""
    p = F.upper(F.trim(F.coalesce(pick, F.lit(""))))
    fine = p.isin("X", "Y")
    return {"pick": F.when(fine, p), "conf": F.when(fine, clamp(safe_int(conf, 60), 55, 92)).otherwise(F.lit(50))}


def sample_weight(is_fresh: Column, factor: Column) -> Column:
    return F.when(is_fresh, F.lit(K.FRESH_WEIGHT)).otherwise(F.lit(K.HISTORICAL_WEIGHT)) * factor


def agreement_factor(pick_name: Column, fact: Column) -> Column:
    """1.5 when the blind pick was right, 0.5 when not, 1 without a pick.  Stored, not used in training."""
    return F.when(pick_name.isNull(), F.lit(1.0)).when(pick_name == fact, F.lit(K.AGREE_FACTOR)).otherwise(
        F.lit(K.DISAGREE_FACTOR))


def result_view(df: DataFrame) -> DataFrame:
    """Presentation columns: percentages, interval text, record text, market label."""
    def record(s: str) -> Column:
        st = F.col(f"stats_{s}")
        return F.concat(st["wins"].cast("string"), F.lit("-"), st["losses"].cast("string"), F.lit(", reach="),
                        st["reach_cm"].cast("string"), F.lit("cm, camp="), st["camp_name"])

    def pct(c: str) -> Column:
        return F.format_string("%.1f%%", F.bround(F.col(c) * 100, 1))

    return df.withColumns({
        "probability_percent": F.bround(F.col("prob") * 100, 2),
        "interval_text": F.concat(pct("ci_lo"), F.lit(" - "), pct("ci_hi")),
        "record_a": record("a"), "record_b": record("b"),
        "market_label": F.when(is_stub(F.col("odds_a"), F.col("odds_b")), "default odds").otherwise("priced")})


