"""Record coercion, parsing of free-text answers, imputation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutlens import constants as K
from boutlens.functions.numbers import percent
from boutlens.operators.entities import as_of

INT_FIELDS = ["wins", "losses", "recent_wins", "age", "exp", "months_off", "fights_12m"]
PERCENT_DEFAULTS = {"fin_rate": 0.5, "sub_rate": 0.0, "td_def": 0.5, "grap_def": 0.5}
HALF_FIELDS = ["stress_factor", "motivation_index", "biorythm_score", "camp_quality", "mystic_factor", "mystic_v2"]
INT_DEFAULTS = {"age": 30}
SIZE_DEFAULTS = {"reach_cm": 180, "height_cm": 175, "dob_quality": 0}


def coerce_stats(raw: Column) -> Column:
    """A typed stat struct from a map of texts.  Unknown keys fall away, missing ones get defaults.

    Experience that is missing or zero becomes wins + losses.
    """
    def text(key: str) -> Column:
        return F.try_element_at(raw, F.lit(key))

    def count(key: str) -> Column:
        given = text(key)
        return F.when(given.isNull(), F.lit(INT_DEFAULTS.get(key, 0))).otherwise(F.coalesce(given.try_cast("int"), F.lit(0)))

    out = {k: count(k) for k in INT_FIELDS}
    out["exp"] = F.when(out["exp"] == 0, out["wins"] + out["losses"]).otherwise(out["exp"])
    out |= {k: F.coalesce(percent(text(k)), F.lit(v)) for k, v in PERCENT_DEFAULTS.items()}
    out |= {k: F.coalesce(text(k).try_cast("double"), F.lit(0.5)) for k in HALF_FIELDS}
    out |= {k: F.coalesce(text(k).try_cast("int"), F.lit(v)) for k, v in SIZE_DEFAULTS.items()}
    out["camp_name"] = F.coalesce(text("camp_name"), F.lit("Independent"))
    out["dob"] = text("dob")
    return F.struct(*[c.alias(k) for k, c in out.items()])


def json_span(raw: Column) -> Column:
    """The text from the first ``{`` to the last ``}``, after code fences are dropped."""
    bare = F.regexp_replace(F.coalesce(raw, F.lit("")), "```json|```", "")
    span = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    return F.when(span != "", span)


def parse_answer(df: DataFrame, raw: str = "raw", required: list[str] | None = None) -> DataFrame:
    """Add ``answer`` (map of texts) and ``missing_keys``; the answer is null unless every key is there."""
    required = required if required is not None else K.ANSWER_KEYS
    parsed = F.from_json(json_span(F.col(raw)), "map<string,string>")
    df = df.withColumn("_parsed", parsed)
    keys = F.coalesce(F.map_keys("_parsed"), F.array().cast("array<string>"))
    df = df.withColumn("missing_keys", F.array_except(F.array(*[F.lit(k) for k in required]), keys))
    return df.withColumn("answer", F.when(F.size("missing_keys") == 0, F.col("_parsed"))).drop("_parsed")


def empty(value: Column) -> Column:
    """Null or zero."""
    return value.isNull() | (value.cast("string") == "0")


def needs_imputing(columns: dict[str, Column]) -> Column:
    """True when any of the key fields is null or zero."""
    return F.greatest(*[empty(c).cast("int") for c in columns.values()]) == 1


def impute(value: Column, fill: Column) -> Column:
    """Keep a value unless it is null or zero."""
    return F.when(empty(value), F.coalesce(fill, value)).otherwise(value)


Enrich = Callable[[DataFrame], DataFrame]


def from_snapshots(snapshots: DataFrame, lag_days: int = 1) -> Enrich:
    """An enrichment step from dated records (fid, day, any fields): the latest at least ``lag_days`` before the bout.

    A step takes (fid, bout_date) rows and returns them with whatever fields it knows; any other source can stand in.
    """
    fields = [c for c in snapshots.columns if c not in ("fid", "day")]

    def enrich(asked: DataFrame) -> DataFrame:
        marks = snapshots.groupBy("fid", "day").agg(*[F.max(c).alias(c) for c in fields])
        found = as_of(asked, marks.select("fid", "day", F.struct(*fields).alias("value")), lag_days)
        return found.filter("as_of_day IS NOT NULL").select("fid", "bout_date", "as_of_day", "value.*")

    return enrich


def impute_rows(sides: DataFrame, enrich: Enrich, keys: list[str] | None = None) -> DataFrame:
    """Side rows (fid, bout_date, fields) with empty fields filled by ``enrich``, and where the values came from.

    A row asks when any of the key fields is null or zero; then every field that it and the source share is filled if
    empty.  Adds ``filled`` (names, in the order of the columns) and ``filled_as_of``.  The source is asked once per (fid, bout_date).
    """
    keys = keys if keys is not None else K.IMPUTE_KEYS
    rows = sides.withColumn("_asks", needs_imputing({k: F.col(k) for k in keys}))
    found = enrich(rows.filter("_asks").select("fid", "bout_date").distinct())
    day = F.col("_f_as_of_day") if "as_of_day" in found.columns else F.lit(None).cast("date")
    fields = [c for c in sides.columns if c in found.columns and c not in ("fid", "bout_date")]
    found = found.select(F.col("fid").alias("_f_fid"), F.col("bout_date").alias("_f_bout_date"), *[F.col(c).alias(f"_f_{c}") for c in found.columns if c in fields or c == "as_of_day"])
    rows = rows.join(found, F.col("_asks") & (F.col("fid") == F.col("_f_fid")) & (F.col("bout_date") == F.col("_f_bout_date")), "left")

    def gap(c: str) -> Column:
        return F.col("_asks") & empty(F.col(c)) & F.col(f"_f_{c}").isNotNull()

    names = F.filter(F.array(*[F.when(gap(c), F.lit(c)) for c in fields]) if fields else F.array().cast("array<string>"), lambda n: n.isNotNull())
    out = [F.when(gap(c), F.col(f"_f_{c}").cast(sides.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in sides.columns]
    return rows.select(*out, names.alias("filled"), F.when(F.size(names) > 0, day).alias("filled_as_of"))
