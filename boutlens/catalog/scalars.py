"""Number, date, array and map queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from boutlens import constants as K
from boutlens.catalog import query
from boutlens.catalog import sqlkit as Q
from boutlens.functions import dates as D
from boutlens.functions import numbers as N
from boutlens.operators import records as R
from boutlens.sources import tables

ODD_VALUE = "CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN CAST('nan' AS DOUBLE) WHEN 2 THEN CAST('inf' AS DOUBLE) WHEN 3 THEN CAST('-inf' AS DOUBLE) ELSE value END"
ODD_TEXT = "CASE event_id % 5 WHEN 0 THEN ' ' || CAST(event_id % 97 AS VARCHAR(9)) || '.75 ' WHEN 1 THEN 'abc' WHEN 2 THEN '' WHEN 3 THEN '-' || CAST(event_id % 97 AS VARCHAR(9)) || '.6' ELSE CAST(event_id AS VARCHAR(9)) END"


@query("safe_val", f"SELECT event_id, CASE WHEN v IS NULL OR isnan(v) OR isinf(v) THEN 0.0::DOUBLE ELSE v END AS v FROM (SELECT event_id, {ODD_VALUE} AS v FROM events)")
def safe_val(spark, d):
    df = tables.table(spark, d, "events").select("event_id", F.expr(ODD_VALUE).alias("v"))
    return df.select("event_id", N.safe_val(F.col("v")).alias("v"))


@query("safe_cast", f"SELECT event_id, coalesce(TRY_CAST(trim(t) AS DOUBLE), 1.85::DOUBLE) AS as_float, CAST(coalesce(trunc(TRY_CAST(trim(t) AS DOUBLE)), 3) AS INT) AS as_int FROM (SELECT event_id, {ODD_TEXT} AS t FROM events)")
def safe_cast(spark, d):
    df = tables.table(spark, d, "events").select("event_id", F.expr(ODD_TEXT).alias("t"))
    return df.select("event_id", N.safe_float(F.col("t"), 1.85).alias("as_float"), N.safe_int(F.col("t"), 3).alias("as_int"))


# A raw record as text fields; a missing key is a null entry here.
RAW_STATS = {
    "fin_rate": "CASE WHEN s_suppkey % 2 = 0 THEN CAST(40 + s_suppkey % 50 AS VARCHAR(9)) ELSE '0.' || CAST(10 + s_suppkey % 80 AS VARCHAR(9)) END",
    "sub_rate": "CASE WHEN s_suppkey % 4 = 0 THEN 'n/k' ELSE CAST(s_suppkey % 60 AS VARCHAR(9)) END",
    "td_def": "CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE '0.' || CAST(10 + s_suppkey % 80 AS VARCHAR(9)) END",
    "stress_factor": "CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE '0.' || CAST(10 + s_suppkey % 80 AS VARCHAR(9)) END",
    "camp_name": "CASE WHEN s_nationkey % 3 = 0 THEN NULL ELSE 'camp_' || CAST(s_nationkey AS VARCHAR(9)) END",
    "wins": "CASE WHEN s_suppkey % 7 = 0 THEN 'many' ELSE CAST(s_suppkey % 40 AS VARCHAR(9)) END",
    "losses": "CAST(s_suppkey % 9 AS VARCHAR(9))",
    "exp": "CASE WHEN s_suppkey % 2 = 0 THEN NULL WHEN s_suppkey % 5 = 0 THEN '0' ELSE '50' END",
}
_pct = lambda c, miss: f"coalesce(CASE WHEN {c} IS NULL THEN {miss} WHEN TRY_CAST({c} AS DOUBLE) IS NULL THEN 0.5::DOUBLE WHEN TRY_CAST({c} AS DOUBLE) > 1.0 THEN TRY_CAST({c} AS DOUBLE) / 100.0::DOUBLE ELSE TRY_CAST({c} AS DOUBLE) END, 0.0)"
_int = lambda c: f"CASE WHEN {c} IS NULL THEN 0 ELSE coalesce(TRY_CAST({c} AS INT), 0) END"


@query("coerce_stats", f"""SELECT s_suppkey, {_pct('fin_rate', '0.5::DOUBLE')} AS fin_rate, {_pct('sub_rate', '0.0::DOUBLE')} AS sub_rate,
  {_pct('td_def', '0.5::DOUBLE')} AS td_def, coalesce(TRY_CAST(stress_factor AS DOUBLE), 0.5::DOUBLE) AS stress_factor,
  coalesce(camp_name, 'Independent') AS camp_name, {_int('wins')} AS wins, {_int('losses')} AS losses,
  CASE WHEN {_int('exp')} = 0 THEN {_int('wins')} + {_int('losses')} ELSE {_int('exp')} END AS exp
  FROM (SELECT s_suppkey, {', '.join(f'{e} AS {k}' for k, e in RAW_STATS.items())} FROM supplier)""")
def coerce_stats(spark, d):
    raw = F.map_filter(F.create_map(*[x for k, e in RAW_STATS.items() for x in (F.lit(k), F.expr(e))]), lambda _, v: v.isNotNull())
    df = tables.table(spark, d, "supplier").select("s_suppkey", raw.alias("raw"))
    stats = R.coerce_stats(F.col("raw"))
    return df.select("s_suppkey", *[stats[k].alias(k) for k in RAW_STATS])


RAW_FIELD = {
    "fin_rate": "CAST((s_suppkey * 13 % 300 - 50) / 100.0 AS DOUBLE)", "sub_rate": "CAST((s_suppkey * 17 % 300 - 50) / 100.0 AS DOUBLE)",
    "td_def": "CAST((s_suppkey * 19 % 300 - 50) / 100.0 AS DOUBLE)", "grap_def": "CAST((s_suppkey * 23 % 300 - 50) / 100.0 AS DOUBLE)",
    "reach_cm": "CAST(120 + s_suppkey * 7 % 140 AS INT)", "height_cm": "CAST(120 + s_suppkey * 11 % 120 AS INT)",
    "stress_factor": "CAST(s_suppkey * 29 % 100 / 100.0 AS DOUBLE)", "motivation_index": "CAST(s_suppkey * 31 % 100 / 100.0 AS DOUBLE)",
    "biorythm_score": "CAST(s_suppkey * 37 % 100 / 100.0 AS DOUBLE)", "camp_quality": "CAST(s_suppkey * 41 % 100 / 100.0 AS DOUBLE)",
    "mystic_v2": "CAST(s_suppkey * 43 % 100 / 100.0 AS DOUBLE)",
}


@query("clamp_stats", "SELECT s_suppkey, " + ", ".join(
    f"greatest({K.FIELD_BOUNDS[k][0]}, least({K.FIELD_BOUNDS[k][1]}, {e})) AS {k}" for k, e in RAW_FIELD.items()) + " FROM supplier")
def clamp_stats(spark, d):
    df = tables.table(spark, d, "supplier").select("s_suppkey", *[F.expr(e).alias(k) for k, e in RAW_FIELD.items()])
    fixed = N.clamp_fields({k: F.col(k) for k in RAW_FIELD})
    return df.select("s_suppkey", *[c.alias(k) for k, c in fixed.items()])


@query("age_caps", """SELECT c_custkey, CASE WHEN title = 1 THEN greatest(m2, 0.80::DOUBLE) ELSE m2 END AS motivation, b2 AS biorythm FROM (
  SELECT *, CASE WHEN age >= 38 THEN least(m, 0.75::DOUBLE) WHEN age >= 35 THEN least(m, 0.85::DOUBLE) ELSE m END AS m2,
    CASE WHEN age >= 38 THEN least(b, 0.70::DOUBLE) WHEN age >= 35 THEN least(b, 0.80::DOUBLE) WHEN age <= 25 THEN greatest(b, 0.70::DOUBLE) ELSE b END AS b2
  FROM (SELECT c_custkey, 20 + c_custkey % 25 AS age, (30 + c_custkey * 7 % 66) / 100.0::DOUBLE AS m,
    (35 + c_custkey * 11 % 61) / 100.0::DOUBLE AS b, CASE WHEN c_nationkey % 4 = 0 THEN 1 ELSE 0 END AS title FROM customer))""")
def age_caps(spark, d):
    k = F.col("c_custkey")
    m, b = N.age_caps(20 + k % 25, (30 + k * 7 % 66) / 100.0, (35 + k * 11 % 61) / 100.0, F.col("c_nationkey") % 4 == 0)
    return tables.table(spark, d, "customer").select("c_custkey", m.alias("motivation"), b.alias("biorythm"))


@query("template_flag", """SELECT c_custkey, CASE WHEN 20 + c_custkey % 4 = 22 AND 4 + c_custkey % 3 = 5 AND 184 + c_nationkey % 2 = 185
  AND abs((43 + c_custkey % 5) / 100.0::DOUBLE - 0.45::DOUBLE) < 0.01 THEN 1 ELSE 0 END AS is_template FROM customer""")
def template_flag(spark, d):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    flag = N.is_template(20 + k % 4, 4 + k % 3, 184 + n % 2, (43 + k % 5) / 100.0)
    return tables.table(spark, d, "customer").select("c_custkey", flag.cast("int").alias("is_template"))


def _step(base, mod, by):
    return f"round({base}::DOUBLE + (h % {mod}) * {by}::DOUBLE, 2)"


@query("hash_impute", f"""SELECT c_custkey, 28 + h % 8 AS age, 12 + h % 10 AS wins, 3 + h % 5 AS losses, 2 + h % 3 AS recent_wins,
  {_step(0.30, 5, 0.08)} AS fin_rate, {_step(0.0, 3, 0.08)} AS sub_rate, {_step(0.40, 5, 0.06)} AS td_def, {_step(0.40, 5, 0.06)} AS grap_def,
  h % 5 AS months_off, 1 + h % 3 AS fights_12m, 170 + h % 20 AS reach_cm, 170 + h % 15 AS height_cm,
  ({Q.lst(K.FALLBACK_CAMPS)})[h + 1] AS camp_name, {_step(0.30, 4, 0.07)} AS stress_factor, {_step(0.50, 4, 0.08)} AS motivation_index,
  {_step(0.50, 4, 0.07)} AS biorythm_score, {_step(0.50, 4, 0.08)} AS camp_quality, {_step(0.50, 4, 0.07)} AS mystic_v2,
  repeat('W', 2 + h % 3) || repeat('L', 3 - h % 3) AS form, format('{{}}-{{:02d}}-{{:02d}}', 1985 + h % 12, h % 12 + 1, h % 28 + 1) AS dob
  FROM (SELECT c_custkey, CAST(list_sum(list_transform(string_split(c_name, ''), lambda c: unicode(c))) % 10 AS INT) AS h FROM customer)""")
def hash_impute(spark, d):
    df = tables.table(spark, d, "customer").select("c_custkey", N.name_code(F.col("c_name")).alias("h"))
    return df.select("c_custkey", *[c.alias(k) for k, c in N.hash_impute(F.col("h")).items()])


@query("form_array", """SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN repeat('W', CAST(least(5, s_suppkey % 8) AS BIGINT)) || repeat('L', CAST(5 - least(5, s_suppkey % 8) AS BIGINT))
  ELSE array_to_string(list_transform(f[1:5], lambda v: CASE WHEN upper(v) IN ('W', 'L') THEN upper(v)
    WHEN coalesce(trunc(TRY_CAST(v AS DOUBLE)), 0) > 0 THEN 'W' ELSE 'L' END), '') END AS form
  FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN ['w', '1', '0', 'L', 'draw', 'W'] ELSE ['2.7', 'l', '-3'] END AS f FROM supplier)""")
def form_array(spark, d):
    k = F.col("s_suppkey")

    def arr(*v):
        return F.array(*[F.lit(x) for x in v])

    form = F.when(k % 3 != 0, F.when(k % 2 == 0, arr("w", "1", "0", "L", "draw", "W")).otherwise(arr("2.7", "l", "-3")))
    return tables.table(spark, d, "supplier").select(k, F.array_join(N.form_array(form, (k % 8).cast("int")), "").alias("form"))


_DOB_TXT = "CASE WHEN o_orderkey % 11 = 0 THEN '1990-13-45' WHEN o_orderkey % 13 = 0 THEN '' ELSE {iso} END"
_DOB_SQL = _DOB_TXT.format(iso="strftime(dob, '%Y-%m-%d')")
_DOB_SPARK = _DOB_TXT.format(iso="date_format(dob, 'yyyy-MM-dd')")
_STATED = "CAST(year(day) - year(dob) + o_orderkey % 9 - 4 AS INT)"


def _births(spark, d):
    df = tables.table(spark, d, "orders").select(
        "o_orderkey", F.to_date("o_orderdate").alias("day"), F.expr("date_add(DATE '1960-01-01', CAST(o_custkey * 97 % 14000 AS INT))").alias("dob"))
    return df.select("o_orderkey", "day", F.expr(_DOB_SPARK).alias("txt"), F.expr(_STATED).alias("age"))


_BIRTHS = f"""(SELECT o_orderkey, day, {_DOB_SQL} AS txt, {_STATED} AS age FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day,
  DATE '1960-01-01' + CAST(o_custkey * 97 % 14000 AS INT) AS dob FROM orders))"""


@query("dob_quality", f"""SELECT o_orderkey, CASE WHEN b IS NOT NULL AND NOT (abs({Q.age_on('day', 'b')} - age) > 3
   OR (month(b) = 3 AND day(b) BETWEEN 12 AND 15)) THEN txt ELSE '' END AS dob,
   CASE WHEN b IS NOT NULL AND NOT (abs({Q.age_on('day', 'b')} - age) > 3 OR (month(b) = 3 AND day(b) BETWEEN 12 AND 15)) THEN 1 ELSE 0 END AS dob_quality
  FROM (SELECT *, TRY_CAST(txt AS DATE) AS b FROM {_BIRTHS})""")
def dob_quality(spark, d):
    df = _births(spark, d).withColumn("dob", D.dob_checked(F.col("txt"), F.col("day"), F.col("age")))
    return df.select("o_orderkey", "dob", (F.col("dob") != "").cast("int").alias("dob_quality"))


@query("dob_verify", f"""SELECT o_orderkey, CASE WHEN length(txt) < 4 THEN CAST(g AS VARCHAR) WHEN length(txt) = 4 THEN txt
   WHEN b IS NULL THEN CAST(g AS VARCHAR) WHEN abs(year(b) - g) <= 1 THEN txt ELSE CAST(g AS VARCHAR) END AS dob
  FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 17 = 0 THEN '1988' ELSE txt END AS txt, year(day) - age AS g,
     TRY_CAST(CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE txt END AS DATE) AS b FROM {_BIRTHS})""")
def dob_verify(spark, d):
    txt = F.when(F.col("o_orderkey") % 17 == 0, "1988").otherwise(F.col("txt"))
    day = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("day", "yyyy-MM-dd")).otherwise(F.date_format("day", "dd.MM.yyyy"))
    return _births(spark, d).select("o_orderkey", D.dob_by_age(txt, F.col("age"), day).alias("dob"))


@query("digit_root", f"SELECT o_orderkey, CAST({Q.digit_root('(o_orderkey - 5)')} AS INT) AS root FROM orders")
def digit_root(spark, d):
    return tables.table(spark, d, "orders").select("o_orderkey", N.digit_root(F.col("o_orderkey") - 5).alias("root"))


_TXT = "CASE o_orderkey % 5 WHEN 0 THEN {iso} WHEN 1 THEN {dmy} WHEN 2 THEN {year} WHEN 3 THEN {short} ELSE 'n/a 12' END"
_TXT_SQL = _TXT.format(iso="strftime(o_orderdate, '%Y-%m-%d')", dmy="strftime(o_orderdate, '%d.%m.%Y')", year="strftime(o_orderdate, '%Y')",
                       short="(day(o_orderdate) || '/' || month(o_orderdate) || '/' || year(o_orderdate))")
_TXT_SPARK = _TXT.format(iso="date_format(o_orderdate, 'yyyy-MM-dd')", dmy="date_format(o_orderdate, 'dd.MM.yyyy')", year="date_format(o_orderdate, 'yyyy')",
                         short="(day(o_orderdate) || '/' || month(o_orderdate) || '/' || year(o_orderdate))")


@query("date_number", f"SELECT o_orderkey, coalesce({Q.date_number('t')}, 0) AS n FROM (SELECT o_orderkey, {_TXT_SQL} AS t FROM orders)")
def date_number(spark, d):
    df = tables.table(spark, d, "orders").select("o_orderkey", F.expr(_TXT_SPARK).alias("t"))
    return df.select("o_orderkey", F.coalesce(D.date_number(F.col("t")), F.lit(0)).alias("n"))


_PARSED = """CASE o_orderkey % 5 WHEN 2 THEN make_date(year(o_orderdate), 1, 1) WHEN 4 THEN NULL ELSE CAST(o_orderdate AS DATE) END"""


@query("date_parse", f"SELECT o_orderkey, coalesce(strftime({_PARSED}, '%Y-%m-%d'), '') AS parsed FROM orders")
def date_parse(spark, d):
    df = tables.table(spark, d, "orders").select("o_orderkey", F.expr(_TXT_SPARK).alias("t"))
    return df.select("o_orderkey", F.coalesce(F.date_format(D.parse_date(F.col("t")), "yyyy-MM-dd"), F.lit("")).alias("parsed"))


_flat = Q.lst([v for row in K.COMPATIBILITY for v in row])


@query("compat", f"""SELECT o_orderkey, CASE WHEN b BETWEEN 1 AND 9 AND n BETWEEN 1 AND 9 THEN ({_flat})[(b - 1) * 9 + n] ELSE 0.5::DOUBLE END AS compat
  FROM (SELECT o_orderkey, o_custkey % 11 AS b, o_orderkey % 12 AS n FROM orders)""")
def compat(spark, d):
    c = D.compatibility(F.col("o_custkey") % 11, F.col("o_orderkey") % 12)
    return tables.table(spark, d, "orders").select("o_orderkey", c.alias("compat"))


@query("moon_value", f"SELECT o_orderkey, {Q.moon_value('p')} AS moon FROM (SELECT o_orderkey, {Q.moon_phase('CAST(o_orderdate AS DATE)')} AS p FROM orders)")
def moon_value(spark, d):
    return tables.table(spark, d, "orders").select("o_orderkey", D.moon_value(F.to_date("o_orderdate")).alias("moon"))


@query("moon_name", "SELECT o_orderkey, CASE WHEN p < 0.0625 OR p >= 0.9375 THEN 'new moon' " + " ".join(
    f"WHEN p < {0.0625 + i * 0.125} THEN '{K.MOON_PHASES[i]}'" for i in range(1, 8)) +
    f" END AS moon FROM (SELECT o_orderkey, {Q.moon_phase('CAST(o_orderdate AS DATE)')} AS p FROM orders)")
def moon_name(spark, d):
    return tables.table(spark, d, "orders").select("o_orderkey", D.moon_name(F.to_date("o_orderdate")).alias("moon"))


_day = f"coalesce({_PARSED}, NULL)"


@query("mystic_factor", f"""SELECT o_orderkey, {Q.mystic_value('b', 'n', "CASE WHEN p IS NULL THEN 0.5::DOUBLE ELSE " + Q.moon_value('p') + " END")} AS mystic_factor,
  CASE WHEN o_orderkey % 11 <> 0 AND o_orderkey % 13 = 0 THEN 'none' ELSE 'full' END AS dob_mode,
  coalesce(b, 5) AS birth_number, coalesce(n, 5) AS day_number, CASE WHEN p IS NULL THEN 0.5::DOUBLE ELSE {Q.moon_value('p')} END AS moon_value
  FROM (SELECT o_orderkey, {Q.date_number('txt')} AS b, {Q.date_number('t')} AS n, CASE WHEN pd IS NULL THEN NULL ELSE {Q.moon_phase('pd')} END AS p
  FROM (SELECT x.o_orderkey, x.txt, {_TXT_SQL.replace('o_orderkey', 'o.o_orderkey')} AS t, {_PARSED.replace('o_orderkey', 'o.o_orderkey')} AS pd FROM {_BIRTHS} x JOIN orders o USING (o_orderkey)))""")
def mystic(spark, d):
    df = tables.table(spark, d, "orders").select(
        "o_orderkey", F.expr(_TXT_SPARK).alias("t"),
        F.expr("date_add(DATE '1960-01-01', CAST(o_custkey * 97 % 14000 AS INT))").alias("dob"))
    df = df.select("o_orderkey", "t", F.expr(_DOB_SPARK).alias("txt"))
    df = D.with_mystic_parts(df, F.col("txt"), F.col("t"))
    return df.select("o_orderkey", "mystic_factor", "dob_mode", "birth_number", "day_number", "moon_value")


_CAMP = f"CASE WHEN s_suppkey % 5 = 0 THEN 'nowhere' ELSE {{pick}} END"


@query("camp_encode", f"""SELECT s_suppkey, coalesce(CASE camp {' '.join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in K.CAMP_SCORES.items())} END, 0.4::DOUBLE) AS score
  FROM (SELECT s_suppkey, {_CAMP.format(pick='(' + Q.lst(list(K.CAMP_SCORES)) + ')[s_suppkey % 16 + 1]')} AS camp FROM supplier)""")
def camp_encode(spark, d):
    k = F.col("s_suppkey")
    pick = F.element_at(F.array(*[F.lit(c) for c in K.CAMP_SCORES]), (k % 16 + 1).cast("int"))
    return tables.table(spark, d, "supplier").select(k, N.camp_score(F.when(k % 5 == 0, "nowhere").otherwise(pick)).alias("score"))


@query("rounds_fix", "SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, CASE WHEN l_linenumber IN (3, 5) THEN l_linenumber ELSE 3 END AS rounds FROM lineitem")
def rounds_fix(spark, d):
    return tables.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", N.valid_rounds(F.col("l_linenumber")).alias("rounds"))


