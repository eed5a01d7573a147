"""Payment matching, limits, balances, snapshots and progress as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from boutlens import constants as K
from boutlens.sources.feeds import progress_lines


def match_payments(receipts: DataFrame, reservations: DataFrame, seconds: int = K.PAYMENT_WINDOW_SECONDS) -> DataFrame:
    """Stream-stream join of receipts with open reservations of the same amount.

    Watermarks on both sides bound the state to the window.  The join gives every
    fitting pair; `first_match` keeps one reservation per receipt per micro-batch.
    """
    delay = f"{seconds} seconds"
    r = receipts.withWatermark("ts", delay).select(F.col("event_id").alias("receipt_id"), F.col("ts").alias("paid_at"), F.col("amount").alias("paid"))
    p = reservations.withWatermark("ts", delay).select(F.col("event_id").alias("reservation_id"), F.col("ts").alias("reserved_at"), "amount")
    return r.join(p, F.expr(f"paid = amount AND reserved_at <= paid_at AND reserved_at >= paid_at - interval {seconds} seconds")).drop("paid")


def first_match(pairs: DataFrame) -> DataFrame:
    """One-to-one step for ``foreachBatch``: earliest reservation per receipt, then earliest receipt per reservation."""
    one = pairs.groupBy("receipt_id").agg(F.min(F.struct("reserved_at", "reservation_id", "paid_at", "amount")).alias("m"))
    flat = one.select("receipt_id", "m.*")
    best = flat.groupBy("reservation_id").agg(F.min(F.struct("paid_at", "receipt_id", "amount")).alias("m"))
    return best.select("reservation_id", "m.*")


def fresh_snapshots(snapshots: DataFrame, keys: list[str], ttl: int = K.ODDS_TTL_SECONDS) -> DataFrame:
    """First snapshot per key and TTL: repeats inside the TTL are dropped, state expires with the watermark."""
    return snapshots.withWatermark("ts", f"{ttl} seconds").dropDuplicatesWithinWatermark(keys)


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and totals per event type and window; rows later than ``late`` are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(
        F.count("*").alias("n"), F.sum("value").alias("total")).select("window.start", "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "2 hours", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(
        F.count("*").alias("n")).select("user_id", "session_window.start", "session_window.end", "n")


def latest_progress(lines: DataFrame, run: str = "run_id", seq: str = "seq") -> DataFrame:
    """Latest stage and final result per run; use update or complete output."""
    p = progress_lines(lines)
    stage = F.when(F.col("kind") == "stage", F.col("title"))
    final = F.when(F.col("kind") == "final_result", F.col("title"))
    return p.groupBy(run).agg(
        F.max_by(stage, F.when(stage.isNotNull(), F.col(seq))).alias("stage"),
        F.max_by(final, F.when(final.isNotNull(), F.col(seq))).alias("result"))


def _ordered(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(frames)).sort_values(["ts", "event_id"])


def limit_training(requests: DataFrame, hours: int = K.TRAINING_PAUSE_HOURS) -> DataFrame:
    """Per device: one allowed request per ``hours`` since the last *allowed* one, pro devices always.

    ``requests``: user_id, ts, event_id, is_pro.  State is one timestamp per device; the
    rows of one call are those of one device in one micro-batch, so its size is set by the trigger.
    """
    pause = pd.Timedelta(hours=hours)

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = pd.Timestamp(state.get[0], unit="us") if state.exists else None
        df = _ordered(frames)
        allowed = []
        for ts, pro in zip(df["ts"], df["is_pro"]):
            fine = bool(pro) or last is None or ts - last >= pause
            if fine and not pro:
                last = ts
            allowed.append(int(fine))
        if last is not None:
            state.update((int(last.value // 1000),))
        yield pd.DataFrame({"user_id": df["user_id"], "event_id": df["event_id"], "allowed": allowed})

    return requests.groupBy("user_id").applyInPandasWithState(
        step, "user_id long, event_id long, allowed int", "last_us long", "append", GroupStateTimeout.NoTimeout)


def balances(moves: DataFrame, start: int = K.TRIAL_PREDICTIONS) -> DataFrame:
    """Per device: running balance with a floor at zero; a debit on an empty balance is rejected.

    A balance of -1 is unlimited and never changes; ``expires_at`` in the past rejects
    debits.  ``moves``: user_id, ts, event_id, delta, expires_at (may be null).
    """
    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        balance = state.get[0] if state.exists else start
        df = _ordered(frames)
        after, accepted = [], []
        for ts, delta, expires in zip(df["ts"], df["delta"], df["expires_at"]):
            expired = delta < 0 and not pd.isna(expires) and ts > expires
            fine = not expired and (balance == -1 or balance + delta >= 0)
            if fine and balance != -1:
                balance += int(delta)
            after.append(balance)
            accepted.append(int(fine))
        state.update((balance,))
        yield pd.DataFrame({"user_id": df["user_id"], "event_id": df["event_id"], "balance": after, "accepted": accepted})

    return moves.groupBy("user_id").applyInPandasWithState(
        step, "user_id long, event_id long, balance int, accepted int", "balance int", "append", GroupStateTimeout.NoTimeout)
