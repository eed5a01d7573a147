"""Balances, payments and licences over event tables.

Histories per user or per amount are scanned in sorted ranges (`ranges`) whose edges follow the measured amounts of
rows, so that one busy user or one popular amount is spread over many tasks and the upper level holds one row per range.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutlens import constants as K
from boutlens.operators.ranges import in_order, running


def micros(ts: Column | str) -> Column:
    """Microseconds since the epoch of a timestamp with or without zone."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def running_balance(events: DataFrame, key: str = "user_id", start: int = 0) -> DataFrame:
    """Balance after each event when every step is ``max(0, balance + delta)``.

    The walk with a floor has a closed form, sum - min(0, lowest sum so far), and both
    parts are running totals over sorted ranges: no list of a user's events is ever collected.
    ``events``: key, ts, event_id, delta.  Adds ``plain`` (without the floor) and ``balance``.
    A step below the floor takes what is there; accounts that reject a debit larger than the balance are `accounts.walk`.
    """
    rows = running(in_order(events, [key], ["ts", "event_id"], "balances"), [key], {"_s": ("sum", F.col("delta").cast("long"))})
    rows = running(rows, [key], {"_low": ("min", F.col("_s"))})
    plain = F.col("_s") + start
    return rows.withColumns({"plain": plain, "balance": plain - F.least(F.lit(0), F.col("_low") + start)}).drop("_s", "_low", "_part", "_row")


def final_balance(events: DataFrame, key: str = "user_id", start: int = 0) -> DataFrame:
    """Per key: final balance, accepted and rejected debits.  A debit on an empty balance is rejected."""
    walked = running_balance(events, key, start)
    last = F.max_by("balance", F.struct("ts", "event_id"))
    debits = F.count_if(F.col("delta") < 0)
    g = walked.groupBy(key).agg(last.alias("balance"), F.max_by("plain", F.struct("ts", "event_id")).alias("_plain"), debits.alias("_debits"))
    rejected = F.col("balance") - F.col("_plain")
    return g.select(key, "balance", (F.col("_debits") - rejected).alias("accepted"), rejected.alias("rejected"))


def previous_time(events: DataFrame, key: str) -> DataFrame:
    """Add ``previous_ts``: time of the key's previous event."""
    rows = in_order(events, [key], ["ts", "event_id"], "previous")
    return running(rows, [key], {"previous_ts": ("max", F.col("ts"))}, inclusive=False).drop("_part", "_row")


def sessions(events: DataFrame, key: str = "user_id", gap: int = 7200) -> DataFrame:
    """(key, start, end, n): runs of events with at most ``gap`` seconds between neighbours.

    Events are numbered by session in sorted ranges, so the sessions of a hot key are put together over the edges of its
    ranges and its events never meet in one task.
    """
    rows = in_order(events.select(key, "ts", "event_id"), [key], ["ts", "event_id"], "sessions")
    rows = running(rows, [key], {"_before": ("max", F.col("ts"))}, inclusive=False)
    opens = F.col("_before").isNull() | (micros("ts") - micros("_before") > gap * 1_000_000)
    rows = running(rows, [key], {"_session": ("sum", opens.cast("long"))})
    out = rows.groupBy(key, "_session").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("n"))
    return out.drop("_session")


def rate_limit(events: DataFrame, key: str, pro: Column, hours: int = K.TRAINING_PAUSE_HOURS) -> DataFrame:
    """At most one event per ``hours`` after the previous one; pro keys are free.  Adds allowed and hours_left."""
    df = previous_time(events, key)
    gap = (micros("ts") - micros("previous_ts")) / 3600000000.0
    blocked = ~pro & F.col("previous_ts").isNotNull() & (gap < hours)
    return df.withColumns({"allowed": (~blocked).cast("int"), "hours_left": F.when(blocked, hours - gap).otherwise(F.lit(0.0))})


def match_payments(receipts: DataFrame, reservations: DataFrame, seconds: int = K.PAYMENT_WINDOW_SECONDS) -> DataFrame:
    """Each receipt with the earliest reservation of the same amount made up to ``seconds`` before it.

    A reservation goes to its earliest receipt only.  Each receipt is put at the start of its window among the reservations of its
    amount; read backwards in sorted ranges, the last reservation seen is the first one after that moment.  No receipt-reservation
    pairs are formed, and a popular amount is spread over ranges.  Both inputs: event_id, ts, amount.
    """
    moment = lambda us, kind, i: {"_t": -us, "_kind": -F.lit(kind), "_id": -i}
    offers = reservations.select("amount", F.struct("ts", F.col("event_id").alias("reservation_id")).alias("_res"))
    ask = receipts.select("amount", F.struct("ts", F.col("event_id").alias("receipt_id")).alias("_rec"))
    offers = offers.withColumn("_rec", F.lit(None).cast(ask.schema["_rec"].dataType)).withColumns(moment(micros(F.col("_res.ts")), 1, F.col("_res.reservation_id")))
    marks = ask.withColumn("_res", F.lit(None).cast(offers.schema["_res"].dataType)).withColumns(moment(micros(F.col("_rec.ts")) - seconds * 1_000_000, 0, F.col("_rec.receipt_id")))
    rows = in_order(marks.unionByName(offers), ["amount"], ["_t", "_kind", "_id"], "payments")
    rows = running(rows, ["amount"], {"_next": ("max", F.when(F.col("_res").isNotNull(), F.struct("_row", "_res")))})
    hits = rows.filter(F.col("_rec").isNotNull()).withColumn("_hit", F.col("_next._res")).filter(F.col("_hit.ts") <= F.col("_rec.ts"))
    one = hits.groupBy(F.col("_hit.reservation_id").alias("reservation_id"), "amount").agg(F.min("_rec").alias("_rec"))
    return one.select("reservation_id", "_rec.receipt_id", "amount", F.col("_rec.ts").alias("paid_at"))


def amount_collisions(reservations: DataFrame, seconds: int = K.PAYMENT_WINDOW_SECONDS) -> DataFrame:
    """Reservations whose amount was already reserved in the ``seconds`` before."""
    df = previous_time(reservations, "amount")
    gap = (micros("ts") - micros("previous_ts")) / 1000000.0
    return df.filter(gap <= seconds)


def tariff_of(payments: DataFrame, tariffs: DataFrame) -> DataFrame:
    """Tariff by the integer part of the amount; without one the payment failed."""
    dim = tariffs.select(F.col("price").cast("bigint").alias("_price"), "predictions", "days")
    df = payments.withColumn("_price", F.floor("amount").cast("bigint")).join(dim, "_price", "left").drop("_price")
    return df.withColumn("status", F.when(F.col("predictions").isNotNull(), "success").otherwise("failed"))


def apply_payments(paid: DataFrame, key: str = "user_id") -> DataFrame:
    """Per key: predictions bought, latest expiry, failed payments; combined before the shuffle."""
    ok = F.col("status") == "success"
    expiry = F.when(ok & (F.col("days") > 0), F.col("paid_at") + F.make_dt_interval(F.col("days")))
    return paid.groupBy(key).agg(F.coalesce(F.sum(F.when(ok, F.col("predictions"))), F.lit(0)).alias("added"),
                                 F.max(expiry).alias("expires_at"), F.count_if(~ok).alias("failed"))


def registrations(events: DataFrame, key: str, language: Column) -> DataFrame:
    """First call per device creates and grants; later calls only update attributes (last one given wins)."""
    moment = F.struct("ts", "event_id")
    return events.withColumn("_l", language).groupBy(key).agg(
        F.min(moment).alias("_first"), F.max_by("_l", F.when(F.col("_l").isNotNull(), moment)).alias("language"), F.count("*").alias("calls")
    ).select(key, F.col("_first.event_id").alias("created_by"), F.col("_first.ts").alias("created_at"), "language", "calls",
             F.lit(K.TRIAL_PREDICTIONS).alias("granted"))


def activations(events: DataFrame, key: str, is_set: Column, limit: int) -> DataFrame:
    """Balance after the last activation: from the licence limit, walked through all later deltas with the floor at 0."""
    moment = F.struct("ts", "event_id")
    last = events.filter(is_set).groupBy(key).agg(F.max(moment).alias("_set"))
    later = events.join(last, key).filter(moment > F.col("_set"))
    walked = running_balance(later.drop("_set"), key, limit)
    final = walked.groupBy(key).agg(F.max_by("balance", moment).alias("_final"))
    return last.join(final, key, "left").select(key, F.col("_set.event_id").alias("activated_by"), F.coalesce("_final", F.lit(limit)).cast("bigint").alias("balance"))


def user_status(users: DataFrame, licenses: DataFrame, key: str = "user_id") -> DataFrame:
    df = users.join(licenses, key, "left")
    return df.select(key, F.coalesce("balance", F.lit(0)).alias("balance"), F.coalesce("plan", F.lit("free")).alias("plan"),
                     F.coalesce(F.date_format("expires_at", "yyyy-MM-dd"), F.lit("unlimited")).alias("expires"), F.coalesce("is_active", F.lit(0)).alias("is_active"))


def fresh(snapshots: DataFrame, as_of: str, ttl: int = K.ODDS_TTL_SECONDS) -> DataFrame:
    """Snapshots not older than ``ttl`` seconds at ``as_of``; a plain range that reaches the scan."""
    now = F.lit(as_of).cast("timestamp")
    return snapshots.filter((F.col("ts") > now - F.make_dt_interval(secs=F.lit(ttl))) & (F.col("ts") <= now))


def pads(secret: str) -> tuple[str, str]:
    """Inner and outer pad of HMAC-SHA256 for a secret, in hex."""
    code = secret.encode()
    code = (hashlib.sha256(code).digest() if len(code) > 64 else code).ljust(64, b"\0")
    return bytes(c ^ 0x36 for c in code).hex(), bytes(c ^ 0x5C for c in code).hex()


def signature(secret: str):
    """HMAC-SHA256 of a text, first 16 hex digits, as two nested digests."""
    inner, outer = (F.unhex(F.lit(p)) for p in pads(secret))

    def sign(payload: Column) -> Column:
        first = F.sha2(F.concat(inner, payload.cast("binary")), 256)
        return F.substring(F.sha2(F.concat(outer, F.unhex(first)), 256), 1, 16)

    return sign


def audit_keys(keys: DataFrame, secret: str, prefix: str, as_of: str) -> DataFrame:
    """Reason why each (device_id, license_key) is not valid, or an empty text."""
    parts = F.split("license_key", "-")
    df = keys.withColumn("_p", parts)
    p = [F.get("_p", F.lit(i)) for i in range(4)]
    df = df.withColumn("_sig", signature(secret)(F.concat(F.col("device_id"), F.lit(":"), F.coalesce(p[2], F.lit("")))))
    expiry = F.try_to_date(F.when(F.regexp_like(p[2], F.lit(r"^\d{8}$")), p[2]), "yyyyMMdd")
    reason = (F.when((F.size("_p") != 4) | (p[0] != prefix), "bad format").when(p[1] != F.col("device_id"), "other device")
              .when(p[3] != F.col("_sig"), "bad signature").when(expiry.isNull(), "bad date")
              .when(F.lit(as_of).cast("timestamp") > expiry.cast("timestamp"), "expired").otherwise(""))
    return df.withColumn("reason", reason).drop("_p", "_sig")
