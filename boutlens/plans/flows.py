"""From the star-schema tables to scored bouts, as one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boutlens import constants as K
from boutlens.functions.dates import age_on, with_mystic_factor
from boutlens.operators import features as X
from boutlens.operators import history as H
from boutlens.operators import scoring as S
from boutlens.session import short_methods, stored
from boutlens.sources import tables

SIDE_STATS = [
    "name", "fid", "won", "lost", "fin", "sub", "recent_wins", "form", "wins", "losses", "exp", "months_off",
    "fights_12m", "fin_rate", "sub_rate", "age", "dob", "dob_quality", "td_def", "grap_def", "stress_factor",
    "motivation_index", "biorythm_score", "camp_quality", "camp_name", "camp_score", "mystic_factor",
    "mystic_v2", "reach_cm", "height_cm",
]

#: what a side has from its history; the rest of ``SIDE_STATS`` follows from these, the competitor and the day
PAST = ["fid", "won", "lost", "fin", "sub", *H.STATE]

# The fixed model of the supplied tables: an arithmetic rule, not a trained result.
FIXED_WEIGHTS = [((j * 37) % 21 - 10) / 100 for j in range(K.WIDTH)]
FIXED_BIAS = 0.02


def _sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides of each bout with ``PAST``, over stored ranges of the history."""
    return H.carried(stored(spark, f"history{sf_dir}", lambda: H.ranged(tables.bout_sides(tables.bout_core(spark, sf_dir)))))


def side_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sides(spark, sf_dir).withColumns(H.record(F.col)).drop(*H.STATE)


def bout_past(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored history table: one row per bout with the record of both sides before it (``PAST``), and nothing that follows from these.

    Records, attributes, names and features are derived where they are read: stored or shuffled they would be many times as wide.
    """
    return stored(spark, f"past{sf_dir}", lambda: X.pair_sides(_sides(spark, sf_dir), PAST, ["bout_date", "priority"], last=True))


def _with_side(df: DataFrame, dim: DataFrame, s: str) -> DataFrame:
    """``stats_<s>`` with the side's own attributes; null where the competitor is not known.

    The dimension is broadcast only while its measured size is under the session threshold.
    """
    past = F.col(f"stats_{s}")
    df = df.withColumn("_fid", past["fid"]).join(dim.select(F.col("fid").alias("_fid"), F.col("name").alias("_name"), F.col("nation").alias("_nation"), F.lit(True).alias("_known")), "_fid", "left")
    own = tables.static_stats(F.col("_fid"), F.col("_nation"))
    df = df.withColumn("_dob", own["dob"])
    df = with_mystic_factor(df, "_dob", "bout_date")
    values = {f: past[f] for f in PAST} | H.record(lambda c: past[c]) | own | {"name": F.col("_name"), "age": age_on(F.col("bout_date"), F.col("_dob")), "mystic_factor": F.col("mystic_factor"), "dob": F.col("_dob")}
    stats = F.when(F.col("_known"), F.struct(*[values[f].alias(f) for f in SIDE_STATS]))
    return df.withColumn(f"stats_{s}", stats).drop("_fid", "_name", "_nation", "_known", "_dob", "mystic_factor")


def bout_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per bout with ``stats_a`` / ``stats_b`` and the bout's own columns."""
    dim = tables.suppliers(spark, sf_dir).filter("fid IS NOT NULL").dropDuplicates(["fid"])
    paired = _with_side(_with_side(bout_past(spark, sf_dir), dim, "a"), dim, "b").filter("stats_a IS NOT NULL OR stats_b IS NOT NULL")
    a, b = F.col("stats_a"), F.col("stats_b")
    df = paired.withColumns({
        "fighter_a": a["name"], "fighter_b": b["name"],
        "winner_side": F.when(a["won"] == 1, "a").when(b["won"] == 1, "b"),
        "finish": F.greatest(a["fin"], b["fin"]), "submission": F.greatest(a["sub"], b["sub"]),
        "rounds": F.when(F.col("priority") == "1-URGENT", 5).otherwise(3),
        **tables.derived(F.col("bout_id"), F.col("priority"))})
    return tables.name_columns(df)


def with_features(stats: DataFrame) -> DataFrame:
    return stats.select("*", *X.feature_columns(F.col("stats_a"), F.col("stats_b")))


def bout_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every bout with its features, derived from the stored history without a further shuffle."""
    short_methods(spark)
    return with_features(bout_stats(spark, sf_dir))


def score(df: DataFrame, weights=FIXED_WEIGHTS, bias=FIXED_BIAS, scaling: DataFrame | None = None) -> DataFrame:
    """Add ``proba_a``.  ``scaling`` is a one-row frame from `scaling_stats`, read as a scalar subquery."""
    model = S.fold_scaling(scaling if scaling is not None else X.scaling_stats(df), weights, bias)
    df = df.withColumn("_model", model.scalar())
    z = S.linear([F.col(n) for n in K.FEATURE_NAMES], [F.col(f"_model.c{j}") for j in range(K.WIDTH)], F.col("_model.intercept"))
    return df.withColumn("proba_a", S.sigmoid(z)).drop("_model")


def scored_bouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: every bout scored with the fixed model and turned into a prediction."""
    return S.final_prediction(score(bout_features(spark, sf_dir)))
