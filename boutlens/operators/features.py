"""The 46-column feature vector and its scaling statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutlens import constants as K
from boutlens.functions.numbers import safe_val

SIDE_FIELDS = [
    "recent_wins", "fin_rate", "sub_rate", "td_def", "grap_def", "age", "exp", "fights_12m",
    "months_off", "wins", "losses", "stress_factor", "motivation_index", "biorythm_score",
    "camp_quality", "mystic_factor", "mystic_v2",
]


def pair_sides(sides: DataFrame, fields: list[str], common: list[str], last: bool = False) -> DataFrame:
    """Two side rows per bout into one row with ``stats_a`` and ``stats_b``.

    Partitioned once by bout id; the pairing aggregate then needs no further shuffle.  Of repeated rows of a side, any one is
    taken, or with ``last`` the one with the greatest fields.
    """
    pick = F.max if last else lambda c: F.first(c, ignorenulls=True)
    stats = F.struct(*fields)
    grouped = sides.repartition("bout_id").groupBy("bout_id", *common)
    return grouped.agg(
        pick(F.when(F.col("is_a") == 1, stats)).alias("stats_a"),
        pick(F.when(F.col("is_a") == 0, stats)).alias("stats_b"))


def _side_values(s: Column) -> list[Column]:
    out = []
    for f in SIDE_FIELDS:
        v = safe_val(s[f].cast("double"))
        if f == "age":
            v = v / 50.0
        elif f in ("wins", "losses"):
            v = v / 100.0
        elif f.startswith("mystic"):
            v = F.when(F.coalesce(s["dob_quality"], F.lit(0)) > 0, v).otherwise(F.lit(0.5))
        out.append(v)
    return out


def feature_columns(a: Column, b: Column) -> list[Column]:
    """46 named columns from two stat structs, in the fixed order."""
    def val(s: Column, f: str) -> Column:
        return safe_val(s[f].cast("double"))

    crossed = [
        val(a, "fin_rate") * val(a, "td_def"), val(a, "sub_rate") * val(a, "grap_def"),
        val(a, "months_off") / 12.0 * val(a, "exp"), val(a, "stress_factor") * val(a, "camp_quality"),
    ]
    body = [val(s, f) / 200.0 for s in (a, b) for f in ("reach_cm", "height_cm")]
    camps = [a["camp_score"], b["camp_score"]]
    values = _side_values(a) + _side_values(b) + crossed + body + camps + [F.lit(K.CHILDREN_DEFAULT)] * 2
    return [v.alias(n) for v, n in zip(values, K.FEATURE_NAMES)]


def scaling_stats(df: DataFrame, batch: bool = False, skip_ages: bool = True) -> DataFrame:
    """One row ``scaling`` struct(means, stds): population statistics per feature.

    Stored-model form: variance up to 1e-8 gives std 1, the age features stay (0, 1).
    Batch form: every feature, std at least 1e-8.  ``skip_ages=False`` measures the age features too.
    """
    means, stds = [], []
    for i, n in enumerate(K.FEATURE_NAMES):
        sd = F.stddev_pop(n)
        if batch:
            means.append(F.avg(n))
            stds.append(F.greatest(sd, F.lit(1e-8)))
        elif skip_ages and i in K.UNSCALED:
            means.append(F.lit(0.0))
            stds.append(F.lit(1.0))
        else:
            means.append(F.avg(n))
            stds.append(F.when(sd * sd > 1e-8, sd).otherwise(F.lit(1.0)))
    return df.agg(F.struct(F.array(*means).alias("means"), F.array(*stds).alias("stds")).alias("scaling"))


def zscored(means: list, stds: list, names: list[str] | None = None) -> list[Column]:
    """Scaled feature columns; a std at or under 1e-12 counts as 1."""
    out = []
    for i, n in enumerate(names or K.FEATURE_NAMES):
        x = F.col(n)
        if i not in K.UNSCALED:
            sd = stds[i] if isinstance(stds[i], Column) else F.lit(stds[i])
            x = (x - means[i]) / F.when(sd <= 1e-12, F.lit(1.0)).otherwise(sd)
        out.append(x.alias(n))
    return out


def stacked(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Wide features to (keys, idx, name, value), as one narrow generator."""
    items = [F.struct(F.lit(i).alias("idx"), F.lit(n).alias("name"), F.col(n).alias(value))
             for i, n in enumerate(K.FEATURE_NAMES)]
    return df.select(*keys, F.inline(F.array(*items)))
