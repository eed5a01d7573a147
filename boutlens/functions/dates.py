"""Date functions: tolerant parsing, birth dates, day numbers, moon cycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutlens import constants as K
from boutlens.functions.numbers import digit_count, digit_root, digit_sum, round_even_exact


def parse_date(text: Column) -> Column:
    """ISO, ``DD.MM.YYYY`` / ``DD/MM/YYYY`` with or without zeros, or a bare year (1 January)."""
    t = F.trim(text)
    local = r"^(\d{1,2})[./](\d{1,2})[./](\d{4})$"
    iso = F.when(F.regexp_like(t, F.lit(r"^\d{4}-\d{2}-\d{2}$")), F.try_to_date(t, "yyyy-MM-dd"))
    dotted = F.when(F.regexp_like(t, F.lit(local)), F.try_to_date(
        F.concat_ws("-", F.regexp_extract(t, local, 3), F.lpad(F.regexp_extract(t, local, 2), 2, "0"),
                    F.lpad(F.regexp_extract(t, local, 1), 2, "0")), "yyyy-MM-dd"))
    year = F.when(F.regexp_like(t, F.lit(r"^\d{4}$")), F.try_to_date(F.concat(t, F.lit("-01-01")), "yyyy-MM-dd"))
    return F.coalesce(iso, dotted, year)


def age_on(day: Column, dob: Column) -> Column:
    """Completed years."""
    before = (F.month(day) < F.month(dob)) | ((F.month(day) == F.month(dob)) & (F.dayofmonth(day) < F.dayofmonth(dob)))
    return F.year(day) - F.year(dob) - before.cast("int")


def strict_iso(text: Column) -> Column:
    t = F.trim(F.coalesce(text, F.lit("")))
    return F.when(F.regexp_like(t, F.lit(r"^\d{4}-\d{2}-\d{2}$")), F.try_to_date(t, "yyyy-MM-dd"))


def dob_suspect(dob: Column, day: Column, stated_age: Column) -> Column:
    """A birth date that is likely made up: age off by more than 3, or 12-15 March."""
    cluster = (F.month(dob) == 3) & F.dayofmonth(dob).between(12, 15)
    return (F.abs(age_on(day, dob) - stated_age) > 3) | cluster


def dob_checked(dob_text: Column, day: Column, stated_age: Column) -> Column:
    """The date text when it is well formed and not suspect, else an empty string."""
    dob = strict_iso(dob_text)
    fine = dob.isNotNull() & ~dob_suspect(dob, day, stated_age)
    return F.when(fine, F.trim(dob_text)).otherwise(F.lit(""))


def dob_by_age(dob_text: Column, age: Column, day_text: Column) -> Column:
    """Full date when its year fits the age within one year, else a bare year, else empty."""
    fight_year = (F.when(F.contains(day_text, F.lit("-")), F.substring_index(day_text, "-", 1))
                  .when(F.contains(day_text, F.lit(".")), F.substring_index(day_text, ".", -1))).try_cast("int")
    guess = fight_year - age.try_cast("int")
    guess_text = F.coalesce(guess.cast("string"), F.lit(""))
    full = F.try_to_date(F.when(F.regexp_like(F.substring(dob_text, 1, 10), F.lit(r"^\d{4}-\d{2}-\d{2}$")),
                                F.substring(dob_text, 1, 10)), "yyyy-MM-dd")
    return (F.when(dob_text.isNull() | (F.length(dob_text) < 4), guess_text)
            .when(F.regexp_like(dob_text, F.lit(r"^\d{4}$")), dob_text)
            .when(full.isNull(), guess_text)
            .when(F.abs(F.year(full) - guess) <= 1, F.substring(dob_text, 1, 10))
            .otherwise(F.coalesce(guess.cast("string"), F.year(full).cast("string"))))


def date_number(text: Column) -> Column:
    """Digit root of a date text with 4 or at least 8 digits, else null."""
    n = digit_count(text)
    return F.when((n == 4) | (n >= 8), digit_root(digit_sum(text)))


def day_root(day: Column) -> Column:
    """`date_number` of a DATE: a digit root is the number modulo 9, so yyyymmdd will do."""
    return (F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day) - 1) % 9 + 1


def _lookup(values: list, position: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), position)


def compatibility(birth: Column, day: Column) -> Column:
    flat = [v for row in K.COMPATIBILITY for v in row]
    fine = birth.between(1, 9) & day.between(1, 9)
    return F.when(fine, _lookup(flat, (birth - 1) * 9 + day - 1)).otherwise(F.lit(K.NEUTRAL_VALUE))


def moon_phase(day: Column) -> Column:
    """Position in the lunar cycle, 0..1.  `pmod` because dates may precede the epoch."""
    days = (F.datediff(day, F.lit(K.MOON_EPOCH).cast("date")) * 86400 - K.MOON_EPOCH_SECONDS) / 86400.0
    return F.pmod(days, F.lit(K.SYNODIC_DAYS)) / K.SYNODIC_DAYS


def phase_value(phase: Column) -> Column:
    """Eight linear pieces over the cycle, kept in 0.3..0.9, two places."""
    slot = F.least(F.floor(phase * 8).cast("int"), F.lit(7))
    value = _lookup(K.MOON_STARTS, slot) + (phase - slot * 0.125) / 0.125 * _lookup(K.MOON_SLOPES, slot)
    return F.when(phase.isNotNull(), F.bround(F.greatest(F.lit(0.3), F.least(F.lit(0.9), value)), 2))


def moon_value(day: Column) -> Column:
    """`phase_value` of a date; 0.5 without one."""
    return F.coalesce(phase_value(moon_phase(day)), F.lit(K.NEUTRAL_VALUE))


def moon_name(day: Column) -> Column:
    slot = F.floor(F.pmod(moon_phase(day) + 0.0625, F.lit(1.0)) * 8).cast("int")
    return F.coalesce(_lookup(K.MOON_PHASES, slot), F.lit("unknown"))


def with_mystic_parts(df: DataFrame, dob_text: Column, day_text: Column) -> DataFrame:
    """Add the mystic factor and its components, from texts in any form `parse_date` reads.

    Added in stages: each stage refers to named columns of the one before, so the
    optimizer computes every part once instead of expanding one huge expression.
    """
    n = digit_count(F.coalesce(dob_text, F.lit("")))
    df = df.withColumns({
        "dob_mode": F.when(n == 4, "year").when(n >= 8, "full").otherwise("none"),
        "_b": date_number(dob_text), "_d": date_number(day_text), "_date": parse_date(day_text)})
    df = df.withColumns({
        "birth_value": F.coalesce(_lookup(K.BIRTH_STRENGTH, F.col("_b") - 1), F.lit(K.NEUTRAL_VALUE)),
        "day_value": F.coalesce(_lookup(K.DAY_STRENGTH, F.col("_d") - 1), F.lit(K.NEUTRAL_VALUE)),
        "birth_number": F.coalesce("_b", F.lit(K.NEUTRAL_NUMBER)), "day_number": F.coalesce("_d", F.lit(K.NEUTRAL_NUMBER)),
        "moon_value": moon_value(F.col("_date")), "moon_name": moon_name(F.col("_date"))})
    df = df.withColumn("compatibility", compatibility(F.col("birth_number"), F.col("day_number")))
    return _mean_of_parts(df, "birth_value", "day_value", "compatibility", "moon_value").drop("_b", "_d", "_date")


def _mean_of_parts(df: DataFrame, *parts: str) -> DataFrame:
    first, *others = [F.col(p) * 0.25 for p in parts]
    total = first
    for part in others:
        total = total + part
    df = df.withColumn("_mean", total)
    return df.withColumn("mystic_factor", round_even_exact(F.col("_mean"))).drop("_mean")


def with_mystic_factor(df: DataFrame, dob: str, day: str) -> DataFrame:
    """Add ``mystic_factor`` from two DATE columns; arithmetic only, no text."""
    df = df.withColumns({"_b": day_root(F.col(dob)), "_d": day_root(F.col(day)), "_phase": moon_phase(F.col(day))})
    df = df.withColumns({
        "_bv": _lookup(K.BIRTH_STRENGTH, F.col("_b") - 1), "_dv": _lookup(K.DAY_STRENGTH, F.col("_d") - 1),
        "_cv": compatibility(F.col("_b"), F.col("_d")), "_mv": phase_value(F.col("_phase"))})
    return _mean_of_parts(df, "_bv", "_dv", "_cv", "_mv").drop("_b", "_d", "_phase", "_bv", "_dv", "_cv", "_mv")
