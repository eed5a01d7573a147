"""Keyed stream jobs in event time: rows wait until the watermark has passed them and are then taken in order.

Micro-batches may bring rows in any order; what a job does depends on event time alone, so its result is the one of its batch form
for all rows that come before the watermark.  Later ones are dropped.  State per key is what waits (bounded by the
watermark's delay) and what the job keeps; timers empty both.  Needs the RocksDB state store (`use_rocksdb`).

Each job: rows (key, ts, event_id, ..) in, result rows out, in append mode.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from boutlens import constants as K

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: pandas gives integers beside nulls as floats
PLAIN = {"boolean": bool, "int": int, "long": int, "string": str}


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _us(ts) -> int:
    return pd.Timestamp(ts).value // 1000


class InOrder(StatefulProcessor):
    """Rows of a key in order of (ts, event_id), once the watermark has passed them.

    A job gives the fields it needs besides ts and event_id (``fields``, name -> type), the schema of what it keeps (``kept``, one row), and
    `take`, which gets one row and what is kept, and returns result rows and what to keep (None for nothing).
    """

    fields: dict[str, str] = {}
    kept = ""
    #: seconds after which what is kept is no longer needed, or None for state that lasts
    lasts: int | None = None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        columns = ", ".join(f"{n} {t}" for n, t in self.fields.items())
        self.waiting = handle.getListState("waiting", f"us long, event_id long{', ' + columns if columns else ''}")
        self.state = handle.getValueState("state", self.kept)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [(_us(r.ts), int(r.event_id), *(None if pd.isna(getattr(r, f)) else PLAIN[t](getattr(r, f)) for f, t in self.fields.items())) for frame in rows for r in frame.itertuples(index=False)]
        if new:
            self.waiting.appendList(new)
            for at in {r[0] // 1000 for r in new}:
                self.handle.registerTimer(at)
        yield self._out(key, [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        limit = timerValues.getCurrentWatermarkInMs()
        rows = sorted(self.waiting.get()) if self.waiting.exists() else []
        due, rest = [r for r in rows if r[0] // 1000 <= limit], [r for r in rows if r[0] // 1000 > limit]
        out, kept = [], self.state.get() if self.state.exists() else None
        for r in due:
            result, kept = self.take(r, kept)
            out += result
            if self.lasts is not None:
                self.handle.registerTimer(r[0] // 1000 + self.lasts * 1000 + 1)
        if due:
            self.waiting.clear()
            if rest:
                self.waiting.put(rest)
        kept = self.expire(kept, limit)
        if kept is None:
            self.state.clear()
        else:
            self.state.update(kept)
        yield self._out(key, out)

    def _out(self, key, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(*key, *r) for r in rows], columns=self.columns)

    def take(self, row: tuple, kept: tuple | None) -> tuple[list[tuple], tuple | None]:
        raise NotImplementedError

    def expire(self, kept: tuple | None, limit_ms: int) -> tuple | None:
        return kept

    def close(self) -> None:
        pass


def run(rows: DataFrame, key: str, job: InOrder, schema: str, late: str) -> DataFrame:
    """The job over a stream, one state per value of ``key``; rows more than ``late`` behind the newest are dropped."""
    job.columns = StructType.fromDDL(schema).fieldNames()
    kept = rows.select(key, "ts", "event_id", *job.fields).withWatermark("ts", late)
    return kept.groupBy(key).transformWithStateInPandas(job, StructType.fromDDL(schema), "append", "EventTime")


class Payments(InOrder):
    """Receipts take the earliest open reservation of their amount, made up to ``seconds`` before; a reservation is taken once."""

    fields = {"is_receipt": "boolean"}
    kept = "us array<bigint>, ids array<bigint>"

    def __init__(self, seconds: int):
        self.seconds = self.lasts = seconds

    def take(self, row, kept):
        us, event_id, is_receipt = row
        open_ = [(u, i) for u, i in (zip(*kept, strict=True) if kept else ()) if u >= us - self.seconds * 1_000_000]
        out = []
        if not is_receipt:
            open_.append((us, event_id))
        elif open_:
            out = [(open_.pop(0)[1], event_id, pd.Timestamp(us, unit="us"))]
        return out, ([u for u, _ in open_], [i for _, i in open_]) if open_ else None

    def expire(self, kept, limit_ms):
        """Reservations that no receipt still to come can reach."""
        if not kept:
            return None
        open_ = [(u, i) for u, i in zip(*kept, strict=True) if u // 1000 + self.seconds * 1000 >= limit_ms]
        return ([u for u, _ in open_], [i for _, i in open_]) if open_ else None


def match_payments(receipts: DataFrame, reservations: DataFrame, seconds: int = K.PAYMENT_WINDOW_SECONDS, late: str = "1 hour") -> DataFrame:
    """(amount, reservation_id, receipt_id, paid_at), one to one over all micro-batches.  Inputs: event_id, ts, amount (whole)."""
    both = receipts.select("amount", "ts", "event_id", F.lit(True).alias("is_receipt")).unionByName(reservations.select("amount", "ts", "event_id", F.lit(False).alias("is_receipt")))
    return run(both.withColumn("amount", F.col("amount").cast("long")), "amount", Payments(seconds), "amount long, reservation_id long, receipt_id long, paid_at timestamp", late)


class Limiter(InOrder):
    """One allowed request per pause since the last allowed one; pro devices always."""

    fields = {"is_pro": "boolean"}
    kept = "us bigint"

    def __init__(self, hours: int):
        self.pause = hours * 3600 * 1_000_000
        self.lasts = hours * 3600

    def take(self, row, kept):
        us, event_id, pro = row
        fine = bool(pro) or kept is None or us - kept[0] >= self.pause
        return [(event_id, int(fine))], (us,) if fine and not pro else kept

    def expire(self, kept, limit_ms):
        return None if kept is None or kept[0] // 1000 + self.pause // 1000 < limit_ms else kept


def limit_training(requests: DataFrame, hours: int = K.TRAINING_PAUSE_HOURS, late: str = "1 hour") -> DataFrame:
    """(user_id, event_id, allowed).  ``requests``: user_id, ts, event_id, is_pro."""
    return run(requests, "user_id", Limiter(hours), "user_id long, event_id long, allowed int", late)


class Accounts(InOrder):
    """The rules of `operators.accounts`, event by event."""

    fields = {"kind": "string", "amount": "long", "days": "int", "expires_us": "long"}
    kept = "balance bigint, pro boolean, expires_us bigint, active boolean"

    def __init__(self, trial: int):
        self.trial = trial

    def take(self, row, kept):
        us, event_id, kind, amount, days, until = row
        n, status = amount or 0, "ok"
        if kind != "activate":
            n = max(n, 0)
        if kept is None:
            if kind == "register":
                kept = (self.trial, False, None, True)
            else:
                status = "unknown"
        else:
            balance, pro, expires, active = kept
            if kind == "register":
                status = "none"
            elif kind == "activate":
                balance, pro, expires, active = n, True, until, True
            elif kind == "refund":
                balance += n if balance != -1 else 0
            elif kind == "credit":
                balance += n
                if days and days > 0:
                    new = us + days * 86_400_000_000
                    expires, active = max(expires or new, new), True
            elif kind == "debit":
                if not active:
                    status = "inactive"
                elif expires is not None and us > expires:
                    active, status = False, "expired"
                elif balance != -1 and balance < n:
                    status = "empty"
                elif balance != -1:
                    balance -= n
            kept = (balance, pro, expires, active)
        shown = (0, "", False) if kept is None else (kept[0], "pro" if kept[1] else "free", kept[3])
        return [(event_id, status, *shown)], kept


def accounts(events: DataFrame, trial: int = K.TRIAL_PREDICTIONS, late: str = "1 hour") -> DataFrame:
    """(user_id, event_id, status, balance, plan, is_active) after each event.  ``events`` as for `operators.accounts.walk`."""
    rows = events.withColumn("expires_us", F.unix_micros("expires_at"))
    return run(rows, "user_id", Accounts(trial), "user_id long, event_id long, status string, balance long, plan string, is_active boolean", late)
