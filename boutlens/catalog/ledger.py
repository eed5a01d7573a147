"""Ledger, payment, licence and event-time queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from boutlens.catalog import query
from boutlens.functions.numbers import r6
from boutlens.operators import accounts as A
from boutlens.operators import ledger as L
from boutlens.session import materialize
from boutlens.sources import tables

DELTA = "CASE event_type WHEN 'purchase' THEN 3 WHEN 'view' THEN -1 WHEN 'error' THEN 1 ELSE 0 END"


def events(spark, d):
    return tables.table(spark, d, "events")


def moves(spark, d):
    return events(spark, d).filter("event_type IN ('purchase', 'view', 'error')").select("event_id", "ts", "user_id", F.expr(DELTA).alias("delta"))


_RUN = f"""SELECT *, 20 + sum(delta) OVER w AS plain, min(20 + s) OVER w AS low FROM (SELECT *, sum(delta) OVER w AS s FROM (SELECT event_id, ts, user_id, {DELTA} AS delta
  FROM events WHERE event_type IN ('purchase', 'view', 'error')) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"""


@query("ledger_running", f"SELECT event_id, CAST(plain AS BIGINT) AS plain, CAST(plain - least(0, low) AS BIGINT) AS balance FROM ({_RUN})")
def ledger_running(spark, d):
    return L.running_balance(moves(spark, d), start=20).select("event_id", "plain", "balance")


@query("ledger_fold", f"""SELECT user_id, list_reduce(ds, lambda acc, x: greatest(0, acc + x)) AS balance, n_debits - rejected AS accepted, rejected FROM (
  SELECT user_id, list_prepend(20, list(CAST(delta AS INT) ORDER BY ts, event_id)) AS ds, count(*) FILTER (WHERE delta < 0) AS n_debits,
    CAST(arg_max(-least(0, low), (ts, event_id)) AS BIGINT) AS rejected FROM ({_RUN}) GROUP BY 1)""")
def ledger_fold(spark, d):
    return L.final_balance(moves(spark, d), start=20)


@query("rate_limit_lag", """SELECT event_id, CASE WHEN blocked THEN 0 ELSE 1 END AS allowed, floor(CASE WHEN blocked THEN 24 - gap ELSE 0 END * 1000000.0::DOUBLE + 0.5) / 1000000.0::DOUBLE AS hours_left FROM (
  SELECT *, user_id % 5 <> 0 AND gap IS NOT NULL AND gap < 24 AS blocked FROM (SELECT event_id, user_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 3600000000.0::DOUBLE AS gap
  FROM events WHERE event_type = 'click'))""")
def rate_limit_lag(spark, d):
    clicks = events(spark, d).filter("event_type = 'click'").select("event_id", "ts", "user_id")
    out = L.rate_limit(clicks, "user_id", F.col("user_id") % 5 == 0)
    return out.select("event_id", "allowed", r6(F.col("hours_left")).alias("hours_left"))


def receipts(spark, d):
    return events(spark, d).filter("event_type = 'purchase'").select("event_id", "ts", "user_id", F.floor("value").cast("decimal(12,2)").alias("amount"))


def reservations(spark, d):
    return events(spark, d).filter("event_type = 'click'").select("event_id", "ts", "user_id", F.floor("value").cast("decimal(12,2)").alias("amount"))


def _match_sql(seconds: int) -> str:
    return f"""SELECT reservation_id, receipt_id, paid_at, CAST(amount AS DOUBLE) AS amount FROM (SELECT *, row_number() OVER (PARTITION BY reservation_id ORDER BY paid_at, receipt_id) AS rr FROM (
      SELECT p.event_id AS receipt_id, r.event_id AS reservation_id, p.ts AS paid_at, floor(p.value) AS amount, row_number() OVER (PARTITION BY p.event_id ORDER BY r.ts, r.event_id) AS rn
      FROM events p JOIN events r ON p.event_type = 'purchase' AND r.event_type = 'click' AND floor(p.value) = floor(r.value) AND r.ts <= p.ts AND r.ts >= p.ts - INTERVAL {seconds} SECOND) WHERE rn = 1) WHERE rr = 1"""


def _match(name: str, seconds: int):
    @query(name, f"SELECT reservation_id, receipt_id, amount FROM ({_match_sql(seconds)})")
    def run(spark, d):
        out = L.match_payments(receipts(spark, d), reservations(spark, d), seconds)
        return out.select("reservation_id", "receipt_id", F.col("amount").cast("double").alias("amount"))


_match("payment_match", 900)
_match("payment_match_day", 86400)


@query("amount_collision", """SELECT event_id FROM (SELECT event_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY floor(value) ORDER BY ts, event_id)) AS gap
  FROM events WHERE event_type = 'click') WHERE gap <= 86400000000""")
def amount_collision(spark, d):
    return L.amount_collisions(reservations(spark, d), 86400).select("event_id")


def tariffs(spark, d):
    """Tariff dimension: one price per part size."""
    return tables.table(spark, d, "part").select(F.col("p_size").alias("price"), (F.col("p_size") * 2).alias("predictions"), (F.col("p_size") % 30).alias("days")).distinct()


_TARIFF = "(SELECT DISTINCT p_size AS price, p_size * 2 AS predictions, p_size % 30 AS days FROM part)"


@query("tariff_lookup", f"""SELECT event_id, coalesce(predictions, 0) AS predictions, coalesce(days, 0) AS days, CASE WHEN price IS NULL THEN 'failed' ELSE 'success' END AS status
  FROM events LEFT JOIN {_TARIFF} ON price = floor(value) WHERE event_type = 'purchase'""")
def tariff_lookup(spark, d):
    out = L.tariff_of(receipts(spark, d), tariffs(spark, d))
    return out.select("event_id", F.coalesce("predictions", F.lit(0)).alias("predictions"), F.coalesce("days", F.lit(0)).alias("days"), "status")


def _paid(spark, d):
    matched = L.match_payments(receipts(spark, d), reservations(spark, d), 86400)
    who = receipts(spark, d).select(F.col("event_id").alias("receipt_id"), "user_id")
    return L.tariff_of(matched.join(who, "receipt_id"), tariffs(spark, d))


_PAID = f"(SELECT m.*, e.user_id, predictions, days FROM ({_match_sql(86400)}) m JOIN events e ON e.event_id = m.receipt_id LEFT JOIN {_TARIFF} ON price = floor(amount))"


@query("apply_payments", f"""SELECT user_id, CAST(coalesce(sum(predictions), 0) AS BIGINT) AS added, coalesce(strftime(max(CASE WHEN days > 0 THEN paid_at + to_days(CAST(days AS INT)) END), '%Y-%m-%d %H:%M:%S'), '') AS expires,
  count(*) FILTER (WHERE predictions IS NULL) AS failed FROM {_PAID} GROUP BY 1""")
def apply_payments(spark, d):
    out = L.apply_payments(_paid(spark, d))
    return out.select("user_id", "added", F.coalesce(F.date_format("expires_at", "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias("expires"), "failed")


@query("license_expiry", f"""SELECT user_id, strftime(max(ts + to_days(CAST(days AS INT))), '%Y-%m-%d %H:%M:%S') AS expires FROM events JOIN {_TARIFF} ON price = floor(value) WHERE event_type = 'purchase' AND days > 0 GROUP BY 1""")
def license_expiry(spark, d):
    paid = L.tariff_of(receipts(spark, d).withColumnRenamed("ts", "paid_at"), tariffs(spark, d))
    out = L.apply_payments(paid).filter(F.col("expires_at").isNotNull())
    return out.select("user_id", F.date_format("expires_at", "yyyy-MM-dd HH:mm:ss").alias("expires"))


@query("payment_status", f"SELECT e.event_id, CASE WHEN m.receipt_id IS NULL THEN 'not_found' WHEN m.predictions IS NULL THEN 'failed' ELSE 'success' END AS status FROM events e LEFT JOIN {_PAID} m ON m.receipt_id = e.event_id")
def payment_status(spark, d):
    paid = _paid(spark, d).select(F.col("receipt_id").alias("event_id"), "status")
    return events(spark, d).select("event_id").join(paid, "event_id", "left").select("event_id", F.coalesce("status", F.lit("not_found")).alias("status"))


#: accounts: what the events mean.  Users without a signup are unknown; some debits take 5, some licences are unlimited
ACCOUNT = {
    "kind": "CASE WHEN event_type = 'signup' THEN 'register' WHEN event_type = 'purchase' THEN 'credit' WHEN event_type = 'error' THEN 'refund' WHEN event_type = 'click' AND event_id % 9 = 0 THEN 'activate' WHEN event_type IN ('view', 'click') THEN 'debit' END",
    "amount": "CASE WHEN event_type = 'purchase' THEN event_id % 4 WHEN event_type = 'click' AND event_id % 9 = 0 THEN CASE WHEN event_id % 2 = 0 THEN -1 ELSE 8 END WHEN event_type IN ('view', 'click') AND event_id % 7 = 0 THEN 5 ELSE 1 END",
    "days": "CASE WHEN event_type = 'purchase' THEN CAST(event_id % 3 AS INT) ELSE 0 END",
}


def account_events(spark, d):
    rows = events(spark, d).filter("event_type IN ('signup', 'purchase', 'error', 'click', 'view')")
    expires = F.when(F.expr("event_type = 'click' AND event_id % 9 = 0 AND event_id % 5 <> 0"), F.col("ts").cast("timestamp") + F.expr("make_dt_interval(CAST(event_id % 6 AS INT))"))
    return rows.select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", *[F.expr(x).alias(k) for k, x in ACCOUNT.items()], expires.alias("expires_at"))


#: one step per event of each user
_WALK = f"""WITH RECURSIVE e AS MATERIALIZED (SELECT user_id, ts, event_id, {', '.join(f'{x} AS {k}' for k, x in ACCOUNT.items())},
    CASE WHEN event_type = 'click' AND event_id % 9 = 0 AND event_id % 5 <> 0 THEN ts + to_days(CAST(event_id % 6 AS INT)) END AS until,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE event_type IN ('signup', 'purchase', 'error', 'click', 'view')),
  w(user_id, event_id, i, kind, status, balance, plan, expires, active) AS (SELECT DISTINCT user_id, -1::BIGINT, 0::BIGINT, '', '', 0::BIGINT, '', NULL::TIMESTAMP, false FROM e
   UNION ALL SELECT user_id, event_id, i, kind, status,
     CASE WHEN status <> 'ok' THEN balance WHEN kind = 'register' THEN {A.K.TRIAL_PREDICTIONS} WHEN kind = 'activate' THEN amount WHEN kind = 'credit' THEN balance + amount WHEN balance = -1 THEN -1
       WHEN kind = 'refund' THEN balance + amount ELSE balance - amount END,
     CASE WHEN status <> 'ok' THEN plan WHEN kind = 'register' THEN 'free' WHEN kind = 'activate' THEN 'pro' ELSE plan END,
     CASE WHEN status <> 'ok' THEN expires WHEN kind = 'register' THEN NULL WHEN kind = 'activate' THEN until WHEN kind = 'credit' AND days > 0 THEN greatest(coalesce(expires, ts + to_days(days)), ts + to_days(days)) ELSE expires END,
     CASE WHEN status = 'expired' THEN false WHEN status = 'ok' AND (kind IN ('register', 'activate') OR (kind = 'credit' AND days > 0)) THEN true ELSE active END
   FROM (SELECT e.*, w.balance, w.plan, w.expires, w.active, CASE WHEN e.kind = 'register' THEN CASE WHEN w.plan = '' THEN 'ok' ELSE 'none' END WHEN w.plan = '' THEN 'unknown' WHEN e.kind <> 'debit' THEN 'ok'
       WHEN NOT w.active THEN 'inactive' WHEN w.expires IS NOT NULL AND e.ts > w.expires THEN 'expired' WHEN w.balance = -1 OR w.balance >= e.amount THEN 'ok' ELSE 'empty' END AS status
     FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1))"""


@query("account_walk", f"{_WALK} SELECT event_id, status, balance, plan, coalesce(strftime(expires, '%Y-%m-%d %H:%M:%S'), '') AS expires, CAST(active AS INT) AS is_active FROM w WHERE i > 0")
def account_walk(spark, d):
    out = A.walk(account_events(spark, d))
    return out.select("event_id", "status", "balance", "plan", F.coalesce(F.date_format("expires_at", "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias("expires"), F.col("is_active").cast("int").alias("is_active"))


@query("account_final", f"""{_WALK}, l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY i DESC) AS r FROM w WHERE status <> 'unknown' OR kind = 'debit')
  SELECT user_id, CAST(max(CASE WHEN r = 1 THEN balance END) AS BIGINT) AS balance, max(CASE WHEN r = 1 THEN plan END) AS plan, count(*) FILTER (kind = 'debit' AND status = 'ok') AS accepted, count(*) FILTER (kind = 'debit' AND status <> 'ok') AS rejected
  FROM l WHERE i > 0 GROUP BY 1""")
def account_final(spark, d):
    out = A.final(materialize(A.walk(account_events(spark, d)), "accounts-walked"))
    return out.select("user_id", "balance", "plan", "accepted", "rejected")


_LANG = "CASE event_id % 4 WHEN 0 THEN 'ru' WHEN 1 THEN 'en' END"


@query("registrations", f"""SELECT user_id, arg_min(event_id, (ts, event_id)) AS created_by, coalesce(arg_max({_LANG}, (ts, event_id)) FILTER (WHERE {_LANG} IS NOT NULL), '') AS language, count(*) AS calls, 20 AS granted
  FROM events WHERE event_type = 'signup' GROUP BY 1""")
def registrations(spark, d):
    out = L.registrations(events(spark, d).filter("event_type = 'signup'"), "user_id", F.expr(_LANG))
    return out.select("user_id", "created_by", F.coalesce("language", F.lit("")).alias("language"), "calls", "granted")


@query("activations", f"""SELECT user_id, activated_by, CAST(CASE WHEN moves IS NULL THEN 3 ELSE list_reduce(list_prepend(3, moves), lambda acc, x: greatest(0, acc + x)) END AS BIGINT) AS balance
  FROM (SELECT s.user_id, s.activated_by, list(CAST({DELTA} AS INT) ORDER BY ts, event_id) FILTER (WHERE event_id IS NOT NULL) AS moves FROM
  (SELECT user_id, arg_max(event_id, (ts, event_id)) AS activated_by, max((ts, event_id)) AS k FROM events WHERE event_type = 'purchase' AND event_id % 10 = 0 GROUP BY 1) s
  LEFT JOIN events e ON e.user_id = s.user_id AND (e.ts, e.event_id) > s.k GROUP BY 1, 2)""")
def activations(spark, d):
    df = events(spark, d).withColumn("delta", F.expr(DELTA))
    return L.activations(df, "user_id", F.expr("event_type = 'purchase' AND event_id % 10 = 0"), 3)


@query("user_status", """SELECT c_custkey AS user_id, coalesce(balance, 0) AS balance, coalesce(plan, 'free') AS plan, coalesce(strftime(expires_at, '%Y-%m-%d'), 'unlimited') AS expires, coalesce(is_active, 0) AS is_active
  FROM customer LEFT JOIN (SELECT user_id, count(*) AS balance, CASE WHEN max(value) > 200 THEN 'pro' ELSE 'free' END AS plan, CASE WHEN user_id % 3 = 0 THEN NULL ELSE max(ts) END AS expires_at,
    CASE WHEN count(*) > 10 THEN 1 ELSE 0 END AS is_active FROM events WHERE event_type = 'purchase' GROUP BY 1) ON user_id = c_custkey""")
def user_status(spark, d):
    lic = events(spark, d).filter("event_type = 'purchase'").groupBy("user_id").agg(F.count("*").alias("balance"), F.max("value").alias("top"), F.max("ts").alias("last"))
    lic = lic.select("user_id", "balance", F.when(F.col("top") > 200, "pro").otherwise("free").alias("plan"),
                     F.when(F.col("user_id") % 3 != 0, F.col("last")).alias("expires_at"), (F.col("balance") > 10).cast("int").alias("is_active"))
    return L.user_status(tables.table(spark, d, "customer").select(F.col("c_custkey").alias("user_id")), lic)


@query("ttl_filter", "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 3600 SECOND AND ts <= TIMESTAMP '2024-01-15 12:00:00'")
def ttl_filter(spark, d):
    return L.fresh(events(spark, d), "2024-01-15 12:00:00").select("event_id")


@query("events_tumbling", """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY 1, 2""")
def events_tumbling(spark, d):
    g = events(spark, d).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"))
    return g.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", "total")


@query("events_session", """SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM (
  SELECT user_id, event_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) <= 7200000000 THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, sid""")
def events_session(spark, d):
    g = L.sessions(events(spark, d))
    return g.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("start"), "n")


_SECRET = "example-secret"


def _hmac_sql(payload: str) -> str:
    inner, outer = L.pads(_SECRET)
    return f"substr(sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({payload})))), 1, 16)"


@query("license_audit", f"""WITH k AS (SELECT c_custkey AS k, 'dev' || c_custkey AS device_id, CASE WHEN c_custkey % 5 = 0 THEN '20200101' WHEN c_custkey % 7 = 0 THEN '2030x101' ELSE '20300101' END AS day FROM customer),
  g AS (SELECT *, {_hmac_sql("device_id || ':' || day")} AS sig FROM k),
  l AS (SELECT device_id, day, sig, CASE WHEN k % 17 = 0 THEN 'KEY-short' ELSE concat_ws('-', 'KEY', CASE WHEN k % 11 = 0 THEN 'devX' ELSE device_id END, day, CASE WHEN k % 13 = 0 THEN repeat('0', 16) ELSE sig END) END AS license_key FROM g)
  SELECT device_id, license_key, CASE WHEN len(string_split(license_key, '-')) <> 4 THEN 'bad format' WHEN string_split(license_key, '-')[2] <> device_id THEN 'other device'
    WHEN string_split(license_key, '-')[4] <> sig THEN 'bad signature' WHEN NOT regexp_full_match(day, '[0-9]{{8}}') THEN 'bad date' WHEN day < '20240601' THEN 'expired' ELSE '' END AS reason FROM l""")
def license_audit(spark, d):
    """Signature check by nested digests, without leaving the JVM."""
    k = F.col("c_custkey")
    device = F.concat(F.lit("dev"), k.cast("string"))
    day = F.when(k % 5 == 0, "20200101").when(k % 7 == 0, "2030x101").otherwise("20300101")
    keys = tables.table(spark, d, "customer").select(device.alias("device_id"), day.alias("day"), k)
    signed = keys.withColumn("sig", L.signature(_SECRET)(F.concat("device_id", F.lit(":"), "day")))
    owner = F.when(k % 11 == 0, "devX").otherwise(F.col("device_id"))
    sig = F.when(k % 13 == 0, "0" * 16).otherwise(F.col("sig"))
    text = F.when(k % 17 == 0, "KEY-short").otherwise(F.concat_ws("-", F.lit("KEY"), owner, "day", sig))
    return L.audit_keys(signed.select("device_id", text.alias("license_key")), _SECRET, "KEY", "2024-06-01 00:00:00").select("device_id", "license_key", "reason")
