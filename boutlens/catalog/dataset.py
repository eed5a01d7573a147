"""Data-set queries: parsing, guards, dedup, upsert, splits, sampling, audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from boutlens import constants as K
from boutlens.catalog import query
from boutlens.catalog import sqlkit as Q
from boutlens.operators import dataset as DS
from boutlens.operators import quality as QA
from boutlens.operators import records as R
from boutlens.plans import flows
from boutlens.sources import feeds, tables

B = lambda body: Q.with_(["bouts"], body)


@query("month_scan", B("""SELECT bout_id, fight_key, strftime(bout_date, '%Y-%m') AS month FROM (SELECT *, row_number() OVER
  (PARTITION BY fight_key ORDER BY bout_date, bout_id) AS rn FROM bouts WHERE winner IS NOT NULL) WHERE rn = 1"""))
def month_scan(spark, d):
    return DS.month_scan(tables.bouts(spark, d)).select("bout_id", "fight_key", F.date_format("bout_date", "yyyy-MM").alias("month"))


@query("dedup_first", B("""SELECT bout_id, fight_key FROM (SELECT *, row_number() OVER
  (PARTITION BY fight_key ORDER BY bout_date, bout_id) AS rn FROM bouts) WHERE rn = 1"""))
def dedup_first(spark, d):
    return DS.dedup_first(tables.bouts(spark, d), "fight_key", ["bout_date", "bout_id"]).select("bout_id", "fight_key")


EVENT = "'Card ' || bout_id % 50 || CASE WHEN bout_id % 2 = 0 THEN ' (night ' || rounds || ')' ELSE '' END"


@query("bout_record", Q.with_(["feats"], f"""SELECT bout_id, trim(split_part({EVENT}, '(', 1)) AS event,
  strftime(bout_date, '%Y-%m-%d') AS date, CASE method {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in K.METHOD_CODES.items())} ELSE 'DECISION_UNANIMOUS' END AS method,
  sa_wins AS a_wins, sb_losses AS b_losses, strftime(sa_dob, '%Y-%m-%d') AS a_dob, sb_camp_name AS b_camp,
  {Q.r6('sa_fin_rate')} AS a_fin_rate FROM feats"""))
def bout_record(spark, d):
    df = flows.bout_features(spark, d).withColumn("location", F.expr(EVENT))
    rec = feeds.bout_record(df)
    return rec.select("bout_id", "event", "date", "method", F.col("stats_a.wins").alias("a_wins"), F.col("stats_b.losses").alias("b_losses"),
                      F.col("stats_a.dob").alias("a_dob"), F.col("stats_b.camp_name").alias("b_camp"),
                      (F.floor(F.col("stats_a.fin_rate") * 1000000.0 + 0.5) / 1000000.0).alias("a_fin_rate"))


_REQ = ["age", "wins", "losses", "camp_name", "dob"]
_JSON = ("'{\"age\": ' || CAST(20 + c_custkey % 25 AS VARCHAR(9)) || ', \"wins\": ' || CAST(c_custkey % 30 AS VARCHAR(9)) || "
         "CASE WHEN c_custkey % 5 = 0 THEN '' ELSE ', \"losses\": 3' END || ', \"camp_name\": \"' || c_mktsegment || '\"' || "
         "CASE WHEN c_custkey % 6 = 0 THEN '' ELSE ', \"dob\": \"1990-01-02\"' END || CASE WHEN c_custkey % 7 = 0 THEN '' ELSE '}' END")
_ANSWER = (f"CASE c_custkey % 4 WHEN 0 THEN '```json ' || {_JSON} || ' ```' WHEN 1 THEN 'Here it is: ' || {_JSON} || ' - done' "
           f"WHEN 2 THEN {_JSON} ELSE CASE WHEN c_custkey % 3 = 0 THEN 'no answer' ELSE {_JSON} END END")
_span = "regexp_extract(regexp_replace(raw, '```json|```', '', 'g'), '(?s)\\{.*\\}', 0)"


@query("answer_json_parse", f"""SELECT c_custkey, missing, CASE WHEN missing = '' THEN json_extract_string(j, '$.wins') ELSE '' END AS wins,
  CASE WHEN missing = '' THEN json_extract_string(j, '$.camp_name') ELSE '' END AS camp FROM (
  SELECT c_custkey, j, array_to_string(list_filter({Q.lst(_REQ)}, lambda k: j IS NULL OR NOT list_contains(json_keys(j), k)), ',') AS missing
  FROM (SELECT c_custkey, CASE WHEN s <> '' AND json_valid(s) THEN CAST(s AS JSON) END AS j
  FROM (SELECT c_custkey, {_span} AS s FROM (SELECT c_custkey, {_ANSWER} AS raw FROM customer))))""")
def answer_parse(spark, d):
    df = tables.table(spark, d, "customer").select("c_custkey", F.expr(_ANSWER).alias("raw"))
    df = R.parse_answer(df, required=_REQ)
    return df.select("c_custkey", F.array_join("missing_keys", ",").alias("missing"),
                     F.coalesce(F.try_element_at("answer", F.lit("wins")), F.lit("")).alias("wins"),
                     F.coalesce(F.try_element_at("answer", F.lit("camp_name")), F.lit("")).alias("camp"))


@query("prompt_cache_split", """SELECT event_id, md5(event_type || '_' || props) AS cache_key, CASE WHEN md5(event_type || '_' || props) IN
  (SELECT md5(event_type || '_' || props) FROM events WHERE user_id % 3 = 0) THEN 1 ELSE 0 END AS hit FROM events""")
def prompt_cache_split(spark, d):
    events = tables.table(spark, d, "events")
    asked = events.select("event_id", "event_type", "props")
    cache = feeds.cache_keys(events.filter(F.col("user_id") % 3 == 0), "event_type", "props")
    hits, work = feeds.split_by_cache(asked, cache, "event_type", "props")
    return (hits.select("event_id", "cache_key", F.lit(1).alias("hit"))
            .unionByName(work.select("event_id", "cache_key", F.lit(0).alias("hit"))))


_LINE = ("CASE event_id % 4 WHEN 0 THEN '{\"type\": \"stage\", \"current\": ' || CAST(event_id % 90 AS VARCHAR(9)) || ', \"total\": 90}' "
         "WHEN 1 THEN '{\"status\": \"success\", \"message\": \"' || event_type || '\"}' WHEN 2 THEN 'log: ' || event_type ELSE '' END")


@query("ndjson_events", f"""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'stage' ELSE 'final_result' END AS kind,
  CASE WHEN event_id % 4 = 0 THEN 'bout ' || (event_id % 90) || '/90' ELSE 'success' END AS title FROM events WHERE event_id % 4 IN (0, 1)""")
def ndjson_events(spark, d):
    lines = tables.table(spark, d, "events").select("event_id", F.expr(_LINE).alias("line"))
    return feeds.progress_lines(lines).select("event_id", "kind", "title")


_MODE = "CASE WHEN o_orderkey % 2 = 0 THEN 'predict' ELSE 'train' END"


@query("mode_guard", f"""SELECT o_orderkey, CASE WHEN mode = 'predict' AND day < DATE '1998-01-01' THEN 'date in the past'
  WHEN mode = 'train' AND day > DATE '1998-01-01' THEN 'date in the future' ELSE '' END AS reason
  FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, {_MODE} AS mode FROM orders)""")
def mode_guard(spark, d):
    reason = DS.mode_guard(F.to_date("o_orderdate"), F.expr(_MODE), "1998-01-01")
    return tables.table(spark, d, "orders").select("o_orderkey", reason.alias("reason"))


@query("card_by_local_date", """SELECT event_id, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d') AS local_date,
  CASE WHEN CAST(ts + INTERVAL 9 HOUR AS DATE) = CAST(ts AS DATE) THEN 0 ELSE 1 END AS moved FROM events""")
def card_by_local_date(spark, d):
    events = tables.table(spark, d, "events").withColumn("local_date", feeds.local_date(F.col("ts"), "+09:00"))
    return events.select("event_id", F.date_format("local_date", "yyyy-MM-dd").alias("local_date"),
                         (F.col("local_date") != F.to_date("ts")).cast("int").alias("moved"))


@query("pick_by_index", B("""SELECT bout_id, CAST(rn - 1 AS INT) AS position FROM (SELECT bout_id, row_number() OVER
  (PARTITION BY bout_date ORDER BY bout_id) AS rn FROM bouts) WHERE rn - 1 IN (0, 2, 5)"""))
def pick_by_index(spark, d):
    return DS.pick_positions(tables.bout_core(spark, d), "bout_date", "bout_id", [0, 2, 5, -1]).select("bout_id", "position")


#: what the side records hold before imputation: gaps in each of the six fields
_GAPS = {
    "exp": "CASE WHEN bout_id % 3 = 0 THEN NULL ELSE CAST(fid % 20 AS INT) END",
    "dob": "CASE WHEN fid % 4 = 0 THEN NULL ELSE CAST('1970-01-01' AS DATE) END",
    "dob_quality": "CASE WHEN fid % 7 = 0 THEN 0 ELSE 1 END",
    "camp_name": "CASE WHEN bout_id % 5 <> 0 THEN 'own camp' END",
    "reach_cm": "CASE WHEN fid % 4 = 1 THEN 0 ELSE 180 END",
    "height_cm": "CASE WHEN bout_id % 6 = 0 THEN NULL ELSE 175 END",
}


def _impute_sql() -> str:
    gap = {k: f"({k} IS NULL{'' if k in ('dob', 'camp_name') else f' OR {k} = 0'})" for k in _GAPS}
    own = ", ".join(f"{x} AS {k}" for k, x in _GAPS.items())
    got = ", ".join(f"CASE WHEN {g} THEN coalesce(p_{k}, {k}) ELSE {k} END AS {k}" for k, g in gap.items() if k != "dob")
    names = ", ".join(f"CASE WHEN {g} AND p_{k} IS NOT NULL THEN '{k}' END" for k, g in gap.items())
    some = " OR ".join(f"({g} AND p_{k} IS NOT NULL)" for k, g in gap.items())
    return f"""SELECT bout_id, fid, {got}, coalesce(strftime(CASE WHEN dob IS NULL THEN p_dob ELSE dob END, '%Y-%m-%d'), '') AS dob,
      coalesce(array_to_string([{names}], ','), '') AS filled, coalesce(strftime(CASE WHEN {some} THEN day END, '%Y-%m-%d'), '') AS as_of
      FROM (SELECT s.*, n.day, {', '.join(f'n.{k} AS p_{k}' for k in _GAPS)} FROM (SELECT bout_id, bout_date, fid, {own} FROM sides) s
      ASOF LEFT JOIN profiles n ON n.fid = s.fid AND n.day <= s.bout_date - 1)"""


@query("lazy_impute", Q.with_(["sides", "profiles"], _impute_sql()))
def lazy_impute(spark, d):
    sides = tables.bout_sides(tables.bout_core(spark, d)).select("bout_id", "bout_date", "fid", *[F.expr(x).alias(k) for k, x in _GAPS.items()])
    out = R.impute_rows(sides, R.from_snapshots(tables.profiles(spark, d)))
    return out.select("bout_id", "fid", *[k for k in _GAPS if k != "dob"], F.coalesce(F.date_format("dob", "yyyy-MM-dd"), F.lit("")).alias("dob"),
                      F.array_join("filled", ",").alias("filled"), F.coalesce(F.date_format("filled_as_of", "yyyy-MM-dd"), F.lit("")).alias("as_of"))


@query("holdout_anti", B("""SELECT bout_id, fight_key FROM bouts WHERE fight_key NOT IN (SELECT fight_key FROM bouts WHERE held_out = 1)"""))
def holdout_anti(spark, d):
    df = tables.bouts(spark, d)
    return DS.exclude_holdout(df, df.filter("held_out = 1")).select("bout_id", "fight_key")


@query("upsert_fights", Q.with_(["bouts"], """, placed AS (SELECT *, row_number() OVER (ORDER BY bout_date DESC, bout_id DESC) AS from_end,
    row_number() OVER (PARTITION BY fight_key ORDER BY bout_date, bout_id) AS rn FROM bouts),
  cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fight_key ORDER BY bout_date, bout_id) AS k FROM placed WHERE from_end > 150) WHERE k = 1),
  pend AS (SELECT *, blind_conf + 1 AS conf, row_number() OVER (PARTITION BY fight_key ORDER BY bout_date, bout_id) AS f,
    row_number() OVER (PARTITION BY fight_key ORDER BY bout_date DESC, bout_id DESC) AS l FROM placed WHERE from_end <= 150 OR held_out = 1)
  SELECT coalesce(c.fight_key, p.fight_key) AS fight_key, coalesce(c.bout_id, p.bout_id) AS bout_id, coalesce(q.conf, c.blind_conf) AS blind_conf,
    CASE WHEN c.fight_key IS NULL THEN 'new' WHEN p.fight_key IS NULL THEN 'kept' ELSE 'refreshed' END AS change
  FROM cur c FULL OUTER JOIN (SELECT * FROM pend WHERE f = 1) p ON c.fight_key = p.fight_key
  LEFT JOIN (SELECT * FROM pend WHERE l = 1) q ON q.fight_key = p.fight_key""").replace("\n, placed", ",\nplaced"))
def upsert_fights(spark, d):
    cols = ["fight_key", "bout_id", "bout_date", "blind_conf"]
    df = DS.recent_split(tables.bouts(spark, d), pending=150)
    current = DS.dedup_first(df.filter("stratum <> 'new'"), "fight_key", ["bout_date", "bout_id"]).select(*cols)
    pending = df.filter("stratum = 'new' OR held_out = 1").withColumn("blind_conf", F.col("blind_conf") + 1).select(*cols)
    out = DS.upsert(current, pending, "fight_key", ["bout_date", "bout_id"], ["blind_conf"])
    return out.select("fight_key", "bout_id", "blind_conf", "change")


@query("stamp_ids", B(f""", reg AS (SELECT least(na, nb) AS lo, greatest(na, nb) AS hi, min(CASE WHEN na <= nb THEN ia ELSE ib END) AS lo_id,
    min(CASE WHEN na <= nb THEN ib ELSE ia END) AS hi_id FROM (SELECT {Q.norm_latin('fighter_a')} AS na, {Q.norm_latin('fighter_b')} AS nb,
    {Q.entity_id('fighter_a')} AS ia, {Q.entity_id('fighter_b')} AS ib FROM bouts WHERE bout_id % 3 = 0) GROUP BY 1, 2)
  SELECT bout_id, coalesce(CASE WHEN bout_id % 5 = 0 THEN 'old' END, CASE WHEN na <= nb THEN lo_id ELSE hi_id END, '') AS fighter_a_id,
    coalesce(CASE WHEN na <= nb THEN hi_id ELSE lo_id END, '') AS fighter_b_id
  FROM (SELECT bout_id, {Q.norm_latin('fighter_a')} AS na, {Q.norm_latin('fighter_b')} AS nb FROM bouts) f
  LEFT JOIN reg ON reg.lo = least(na, nb) AND reg.hi = greatest(na, nb)""").replace("\n, reg", ",\nreg"))
def stamp_ids(spark, d):
    from boutlens.functions.text import entity_id
    df = tables.bouts(spark, d)
    reg = df.filter(F.col("bout_id") % 3 == 0).select(
        "fighter_a", "fighter_b", entity_id(F.col("fighter_a")).alias("id_a"), entity_id(F.col("fighter_b")).alias("id_b"))
    fights = df.select("bout_id", "fighter_a", "fighter_b", F.when(F.col("bout_id") % 5 == 0, "old").alias("fighter_a_id"),
                       F.lit(None).cast("string").alias("fighter_b_id"))
    out = DS.stamp_ids(fights, reg)
    return out.select("bout_id", F.coalesce("fighter_a_id", F.lit("")).alias("fighter_a_id"), F.coalesce("fighter_b_id", F.lit("")).alias("fighter_b_id"))


_END = "row_number() OVER (ORDER BY bout_date DESC, bout_id DESC)"


@query("recent_split", B(f"""SELECT bout_id, CASE WHEN e <= 150 THEN 'new' WHEN e <= 300 THEN 'recent' ELSE 'historical' END AS stratum
  FROM (SELECT bout_id, {_END} AS e FROM bouts)"""))
def recent_split(spark, d):
    return DS.recent_split(tables.bout_core(spark, d), pending=150).select("bout_id", "stratum")


@query("eval_slice", B(f"SELECT bout_id, CAST(e AS INT) AS from_end FROM (SELECT bout_id, {_END} AS e FROM bouts) WHERE e BETWEEN 101 AND 200"))
def eval_slice(spark, d):
    return DS.eval_slice(tables.bout_core(spark, d)).select("bout_id", "from_end")


@query("recent_features", Q.with_(["feats"], f"""SELECT bout_id, CAST(e AS INT) AS from_end, {Q.r6('a_fin_rate')} AS a_fin_rate,
  {Q.r6('rust_x_exp_A')} AS rust_x_exp FROM (SELECT *, {_END} AS e FROM feats) WHERE e <= 500"""))
def recent_features(spark, d):
    from boutlens.functions.numbers import r6
    df = DS.latest(flows.bout_features(spark, d), K.RECENT_FEATURES)
    return df.select("bout_id", "from_end", r6(F.col("a_fin_rate")).alias("a_fin_rate"), r6(F.col("rust_x_exp_A")).alias("rust_x_exp"))


SAMPLE_SQL = f"""placed AS MATERIALIZED (SELECT *, {_END} AS e FROM bouts WHERE fight_key NOT IN (SELECT fight_key FROM bouts WHERE held_out = 1)),
  sample AS MATERIALIZED (SELECT *, 1 AS is_fresh FROM placed WHERE e <= 100
  UNION ALL (SELECT *, 1 FROM placed WHERE e > 100 AND e <= 300 ORDER BY md5('42|' || bout_id), bout_id LIMIT 39)
  UNION ALL (SELECT *, 0 FROM placed WHERE e > 300 ORDER BY md5('42|' || bout_id), bout_id LIMIT 60))"""


@query("training_sample", B("").rstrip() + f",\n{SAMPLE_SQL}\nSELECT bout_id, is_fresh FROM sample")
def training_sample(spark, d):
    df = tables.bouts(spark, d)
    df = DS.exclude_holdout(df, df.filter("held_out = 1"))
    return DS.training_sample(df, pending=100).select("bout_id", "is_fresh")


@query("holdout_every_third", B("""SELECT bout_id, seq, CASE WHEN seq % 3 = 0 THEN 1 ELSE 0 END AS held FROM
  (SELECT bout_id, row_number() OVER (ORDER BY bout_date, bout_id) AS seq FROM bouts)"""))
def holdout_every_third(spark, d):
    return DS.every_third(tables.bout_core(spark, d)).select("bout_id", "seq", "held")


@query("batch_by_150", B("""SELECT (seq - 1) // 150 AS batch, count(*) AS n, min(bout_id) AS lo, max(bout_id) AS hi,
  CASE WHEN count(*) = 150 THEN 'trained' ELSE 'buffered' END AS status FROM
  (SELECT bout_id, row_number() OVER (ORDER BY bout_date, bout_id) AS seq FROM bouts) GROUP BY 1"""))
def batch_by_150(spark, d):
    g = DS.batches(tables.bout_core(spark, d)).groupBy("batch").agg(
        F.count("*").alias("n"), F.min("bout_id").alias("lo"), F.max("bout_id").alias("hi"))
    return g.withColumn("status", F.when(F.col("n") == 150, "trained").otherwise("buffered"))


@query("dataset_hash", B("""SELECT count(*) AS n, CAST(sum(CAST('0x' || substr(md5(fight_key), 1, 15) AS BIGINT)) AS VARCHAR) AS fingerprint FROM bouts"""))
def dataset_hash(spark, d):
    return DS.fingerprint(tables.bouts(spark, d), "fight_key")


@query("unique_violations", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def unique_violations(spark, d):
    return QA.duplicates(tables.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


# Audit input: maps of texts whose keys are missing by an arithmetic rule on the order key.
def _absent(j: int) -> str:
    return f"(o_orderkey + {j * 7}) % {10 + j} = 0"


def _audit_frame(spark, d):
    k = F.col("o_orderkey")

    def build(keys, offset, extra=()):
        entries = F.array(*[F.when(~F.expr(_absent(i + offset)), F.struct(F.lit(key), F.expr(_value(key)).cast("string"))) for i, key in enumerate(keys)],
                          *[F.when(k % 50 == 7, F.struct(F.lit(x), F.lit("x"))) for x in extra])
        return F.map_from_entries(F.filter(entries, lambda e: e.isNotNull()))

    return tables.table(spark, d, "orders").select(
        k, F.floor(k / 2000).alias("file"), (k % 2000).alias("pos"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date_text"),
        build(K.BOUT_KEYS, 0).alias("top"), build(K.STAT_KEYS, 20, ["nickname"]).alias("stats_a"), build(K.STAT_KEYS, 45).alias("stats_b"))


def _value(key: str) -> str:
    return {"exp": "o_orderkey % 6", "fin_rate": "o_orderkey % 4", "dob": "CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '1990' END"}.get(key, "o_orderkey % 9 + 1")


_SPEC = [("top", k, i) for i, k in enumerate(K.BOUT_KEYS)] + [("stats_a", k, i + 20) for i, k in enumerate(K.STAT_KEYS)] + [
    ("stats_b", k, i + 45) for i, k in enumerate(K.STAT_KEYS)]
_J = {(s, k): j for s, k, j in _SPEC}


def _audit_sql(rows):
    return " UNION ALL ".join(f"SELECT '{s}' AS scope, '{k}' AS key, n, total, round(n * 100.0::DOUBLE / total, 1) AS pct FROM (SELECT count(*) AS total, "
                              f"count(*) FILTER (WHERE {cond}) AS n FROM orders)" for s, k, cond in rows)


@query("audit_missing", f"SELECT scope, key, n, total, pct FROM ({_audit_sql([(s, k, _absent(j)) for s, k, j in _SPEC])}) WHERE n > 0")
def audit_missing(spark, d):
    return QA.missing_keys(_audit_frame(spark, d)).select("scope", "key", "n", "total", "pct")


@query("audit_fill", _audit_sql([
    ("stats_a", "exp empty", f"{_absent(_J['stats_a', 'exp'])} OR o_orderkey % 6 = 0"),
    ("stats_a", "fin_rate empty", f"{_absent(_J['stats_a', 'fin_rate'])} OR o_orderkey % 4 = 0"),
    ("stats_a", "dob filled", f"NOT ({_absent(_J['stats_a', 'dob'])}) AND o_orderkey % 3 <> 0"),
    ("stats_b", "dob filled", f"NOT ({_absent(_J['stats_b', 'dob'])}) AND o_orderkey % 3 <> 0"),
    ("stats_a", "dob_quality filled", f"NOT ({_absent(_J['stats_a', 'dob_quality'])})"),
    ("stats_b", "dob_quality filled", f"NOT ({_absent(_J['stats_b', 'dob_quality'])})"),
    ("top", "ai_factor present", f"NOT ({_absent(_J['top', 'ai_factor'])})"),
    ("top", "blind_conf present", f"NOT ({_absent(_J['top', 'blind_conf'])})")]))
def audit_fill(spark, d):
    return QA.fill_counts(_audit_frame(spark, d)).select("scope", "key", "n", "total", "pct")


@query("audit_years", "SELECT strftime(o_orderdate, '%Y') AS year, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM orders), 1) AS pct FROM orders GROUP BY 1")
def audit_years(spark, d):
    return QA.years(tables.table(spark, d, "orders"), F.date_format("o_orderdate", "yyyy-MM-dd"))


@query("audit_drift", " UNION ALL ".join(
    f"SELECT '{k}' AS key, n, CASE WHEN n = 0 THEN 'ok' WHEN n < total * 0.1 THEN 'some' ELSE 'many' END AS level FROM "
    f"(SELECT count(*) AS total, count(*) FILTER (WHERE {_absent(_J['stats_a', k])}) AS n FROM orders)" for k in K.STAT_KEYS)
    + "".join(f" UNION ALL SELECT '{k}', count(*), CASE WHEN count(*) = 0 THEN 'ok' ELSE 'many' END FROM orders" for k in K.EXPECTED_FIELDS if k not in K.STAT_KEYS)
    + " UNION ALL SELECT 'nickname', count(*), 'unexpected' FROM orders WHERE o_orderkey % 50 = 7")
def audit_drift(spark, d):
    return QA.drift(_audit_frame(spark, d))


@query("audit_sample", """SELECT o_orderkey // 2000 AS file, o_orderkey, n AS rows_in_file,
  CASE WHEN p = 0 THEN 'first' WHEN p = n // 2 THEN 'middle' ELSE 'last' END AS label
  FROM (SELECT o_orderkey, o_orderkey % 2000 AS p, count(*) OVER (PARTITION BY o_orderkey // 2000) AS n FROM orders) WHERE p IN (0, n // 2, n - 1)""")
def audit_sample(spark, d):
    df = tables.table(spark, d, "orders").select(
        "o_orderkey", F.floor(F.col("o_orderkey") / 2000).alias("file"), (F.col("o_orderkey") % 2000).alias("pos"))
    return QA.samples(df, "file", "pos").select("file", "o_orderkey", "rows_in_file", "label")


#: the service tables' unique columns, with repetitions: relation, column, table, rows, value
_SERVICE = [
    ("users", "device_id", "customer", "true", "'dev' || (c_custkey - CASE WHEN c_custkey % 50 = 0 THEN 1 ELSE 0 END)"),
    ("users", "email", "customer", "true", "CASE WHEN c_custkey % 3 <> 0 THEN lower(c_mktsegment) || (c_custkey % 900) || '@example.org' END"),
    ("payments", "transaction_id", "events", "event_type = 'purchase'", "'tx' || CAST(floor(event_id / 3) AS BIGINT)"),
    ("licenses", "user_id", "events", "event_type = 'signup'", "user_id"),
]


@query("service_keys", " UNION ALL ".join(
    f"SELECT '{relation}' AS relation, '{key}' AS key, CAST({value} AS VARCHAR) AS value, count(*) AS n FROM {source} WHERE {rows} AND ({value}) IS NOT NULL GROUP BY 3 HAVING count(*) > 1"
    for relation, key, source, rows, value in _SERVICE))
def service_keys(spark, d):
    """Devices, addresses, transactions and licences per user that are not unique."""
    return QA.key_violations([(relation, tables.table(spark, d, source).filter(rows).select(F.expr(value).alias(key)), key) for relation, key, source, rows, value in _SERVICE])
