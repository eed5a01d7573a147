"""Numeric functions.  All are Column -> Column and stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from boutlens import constants as K

_SCALE_BITS = 54


def safe_val(x: Column, default: float = 0.0) -> Column:
    """Null, NaN and infinities become ``default``: only finite numbers give x - x = 0."""
    v = x.cast("double")
    return F.when(v - v == 0.0, v).otherwise(F.lit(default))


def safe_float(text: Column, default: float) -> Column:
    return F.coalesce(F.trim(text.cast("string")).try_cast("double"), F.lit(float(default)))


def safe_int(text: Column, default: int) -> Column:
    """Parse as a number and cut the fraction; NaN and infinities give the default."""
    x = F.trim(text.cast("string")).try_cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) > 2147483647), F.lit(default)).otherwise(
        F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x))).cast("int")


def clamp(x: Column, low, high) -> Column:
    """Into low..high; null stays null (``greatest`` and ``least`` alone would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def r6(x: Column) -> Column:
    """Round half up at 6 places for output.

    Plain double arithmetic, so that any engine gets the same bits, and no negative zero.
    """
    return F.floor(x * 1000000.0 + 0.5) / 1000000.0


def round_even_exact(x: Column, places: int = 2) -> Column:
    """Half-even rounding of the binary value of a double in 0.25..4, at 1 or 2 places.

    Decimal rounding would treat a double such as 0.665 as an exact tie.  Here the
    double is taken as the integer x * 2**54, so ties are decided exactly.
    """
    scaled = (x * float(2 ** _SCALE_BITS)).cast("bigint") * (10 ** places)
    whole = F.shiftright(scaled, _SCALE_BITS)
    rest = scaled.bitwiseAND(2 ** _SCALE_BITS - 1)
    half = 2 ** (_SCALE_BITS - 1)
    up = (rest > half) | ((rest == half) & (whole % 2 == 1))
    return (whole + up.cast("int")) / F.lit(float(10 ** places))


def digit_root(n: Column) -> Column:
    """Repeated digit sum, 1..9; non-positive numbers give 1."""
    return F.when(n <= 0, F.lit(1)).otherwise((n - 1) % 9 + 1).cast("int")


def digit_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^0-9]", ""))


def digit_sum(text: Column) -> Column:
    """Sum of the decimal digits of a string, without splitting it into an array."""
    total = F.lit(0)
    for d in range(1, 10):
        total = total + (F.length(text) - F.length(F.replace(text, F.lit(str(d)), F.lit("")))) * d
    return total


def percent(x: Column) -> Column:
    """A rate given as 65 becomes 0.65; text that is no number becomes 0.5."""
    v = x.try_cast("double")
    return F.when(x.isNotNull() & v.isNull(), F.lit(0.5)).when(v > 1.0, v / 100.0).otherwise(v)


def clamp_fields(columns: dict[str, Column]) -> dict[str, Column]:
    """Parse and clamp the bounded fields; counts are ints, rates doubles."""
    out = {}
    for name, raw in columns.items():
        low, high, default = K.FIELD_BOUNDS[name]
        parsed = safe_int(raw, default) if isinstance(default, int) else safe_float(raw, default)
        out[name] = clamp(parsed, low, high)
    return out


def age_caps(age: Column, motivation: Column, biorythm: Column, title: Column) -> tuple[Column, Column]:
    """Caps by age; a title bout then lifts motivation to at least 0.80."""
    m = (F.when(age >= 38, F.least(motivation, F.lit(0.75)))
         .when(age >= 35, F.least(motivation, F.lit(0.85))).otherwise(motivation))
    b = (F.when(age >= 38, F.least(biorythm, F.lit(0.70)))
         .when(age >= 35, F.least(biorythm, F.lit(0.80)))
         .when(age <= 25, F.greatest(biorythm, F.lit(0.70))).otherwise(biorythm))
    return F.when(title, F.greatest(m, F.lit(0.80))).otherwise(m), b


def is_template(wins: Column, losses: Column, reach: Column, stress: Column) -> Column:
    return (wins == 22) & (losses == 5) & (reach == 185) & (F.abs(stress - 0.45) < 0.01)


def name_code(name: Column) -> Column:
    """Sum of the code points modulo 10."""
    points = F.transform(F.filter(F.split(name, ""), lambda c: c != ""), lambda c: F.ascii(c))
    return F.aggregate(points, F.lit(0), lambda x, y: x + y) % 10


def hash_impute(h: Column) -> dict[str, Column]:
    """Deterministic stand-in statistics from `name_code`.

    The camp is drawn at random in the original description; here it follows the
    same code, so that two runs agree.
    """
    def step(base: float, mod: int, by: float) -> Column:
        return F.round(F.lit(base) + (h % mod) * by, 2)

    rw = 2 + h % 3
    return {
        "age": 28 + h % 8, "wins": 12 + h % 10, "losses": 3 + h % 5, "recent_wins": rw,
        "fin_rate": step(0.30, 5, 0.08), "sub_rate": step(0.0, 3, 0.08),
        "td_def": step(0.40, 5, 0.06), "grap_def": step(0.40, 5, 0.06),
        "months_off": h % 5, "fights_12m": 1 + h % 3,
        "reach_cm": 170 + h % 20, "height_cm": 170 + h % 15,
        "camp_name": F.element_at(F.array(*[F.lit(c) for c in K.FALLBACK_CAMPS]), h + 1),
        "stress_factor": step(0.30, 4, 0.07), "motivation_index": step(0.50, 4, 0.08),
        "biorythm_score": step(0.50, 4, 0.07), "camp_quality": step(0.50, 4, 0.08),
        "mystic_v2": step(0.50, 4, 0.07),
        "form": F.concat(F.repeat(F.lit("W"), rw), F.repeat(F.lit("L"), 5 - rw)),
        "dob": F.format_string("%d-%02d-%02d", 1985 + h % 12, h % 12 + 1, h % 28 + 1),
    }


def form_array(form: Column, recent_wins: Column) -> Column:
    """First five results as W/L; a missing form is rebuilt from the win count."""
    k = F.greatest(F.lit(0), F.least(recent_wins, F.lit(5)))
    rebuilt = F.concat(F.array_repeat(F.lit("W"), k), F.array_repeat(F.lit("L"), 5 - k))
    read = F.transform(F.slice(form, 1, 5), lambda v: F.when(F.upper(v).isin("W", "L"), F.upper(v))
                       .otherwise(F.when(safe_int(v, 0) > 0, "W").otherwise("L")))
    return F.when(F.size(F.coalesce(form, F.array().cast("array<string>"))) > 0, read).otherwise(rebuilt)


def camp_score(camp: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in K.CAMP_SCORES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, camp), F.lit(K.UNKNOWN_CAMP))


def is_stub(odds_a: Column, odds_b: Column) -> Column:
    return (F.abs(odds_a - K.STUB_ODDS) < 0.01) & (F.abs(odds_b - K.STUB_ODDS) < 0.01)


def implied_prob(odds: Column) -> Column:
    return F.lit(1.0) / F.greatest(odds, F.lit(1.01))


def valid_rounds(rounds: Column) -> Column:
    return F.when(rounds.isin(3, 5), rounds).otherwise(F.lit(3))


def confidence_factor(conf: Column) -> Column:
    """1 below 70 or when missing, then rising to 1.3 at 85."""
    c = clamp(conf.cast("double"), 60.0, 85.0)
    return F.when(c.isNull() | (c < 70.0), F.lit(1.0)).otherwise(1.0 + (c - 70.0) / 50.0)
