"""Accounts with all rules: registration, activation, debits, refunds, payments, over event histories of any length.

Events (user_id, ts, event_id, kind, amount, days, expires_at) are taken in order of time and id:

register  the first one opens the account: the trial balance, plan free, no expiry; later ones change nothing
activate  plan pro, balance ``amount`` (-1 is unlimited), expiry as given, active again
debit     rejected for unknown, expired, inactive and short accounts; else takes ``amount``, or nothing from an unlimited one
refund    gives ``amount`` back, nothing to an unlimited account
credit    adds ``amount`` (to -1 as a number, so that an unlimited account becomes a limited one); with ``days`` the expiry moves to
          at least so many days from then, and the account is active

Who is known, active and in time follows from the order of events alone and is found by running totals.  Balances are folded: the
effect of a run of events on a balance is a step function, constant or a shift on each piece of balances; functions of neighbouring
runs compose.  A run is at most ``RUN`` events, runs are composed in a tree of ``FAN`` at a time up to one per account, and the balances
come back down.  So an account with a third of all events is many runs in many tasks, and no task holds a history.
"""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutlens import constants as K
from boutlens.operators.ranges import in_order, running
from boutlens.session import materialize

RUN, FAN, TASK = 4096, 1024, 32768

#: a step function: from each start upwards the balance becomes slope * balance + value
Steps = list[tuple[int, int, int]]
SAME: Steps = [(0, 1, 0)]
_STEPS = "starts array<bigint>, slopes array<int>, values array<bigint>"


def _tidy(steps: Steps) -> Steps:
    """Pieces without their repetitions; a shift on one balance alone is a constant."""
    out: Steps = []
    for i, (start, slope, value) in enumerate(steps):
        if slope and i + 1 < len(steps) and steps[i + 1][0] == start + 1:
            slope, value = 0, value + start
        if not out or out[-1][1:] != (slope, value):
            out.append((start, slope, value))
    return out


def then_debit(steps: Steps, n: int) -> Steps:
    """The function, then a debit: ``n`` less where there is as much."""
    out: Steps = []
    for i, (start, slope, value) in enumerate(steps):
        end = steps[i + 1][0] if i + 1 < len(steps) else None
        if not slope:
            out.append((start, 0, value - n if value >= n else value))
            continue
        split = max(start, n - value)
        if split > start:
            out.append((start, 1, value))
        if end is None or split < end:
            out.append((split, 1, value - n))
    return _tidy(out)


def then_add(steps: Steps, n: int) -> Steps:
    return [(start, slope, value + n) for start, slope, value in steps]


def compose(first: Steps, second: Steps) -> Steps:
    """``second`` after ``first``."""
    out: Steps = []
    starts = [s for s, _, _ in second]
    for i, (start, slope, value) in enumerate(first):
        end = first[i + 1][0] if i + 1 < len(first) else None
        at = bisect.bisect_right(starts, slope * start + value) - 1
        while True:
            _, slope2, value2 = second[at]
            out.append((start, slope * slope2, slope2 * value + value2))
            at += 1
            if not slope or at == len(second):
                break
            start = second[at][0] - value
            if end is not None and start >= end:
                break
    return _tidy(out)


def value_at(steps: Steps, balance: int) -> int:
    _, slope, value = steps[bisect.bisect_right([s for s, _, _ in steps], balance) - 1]
    return slope * balance + value


def _pack(rows: list[tuple], steps: list[Steps], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=names)
    for i, c in enumerate(("starts", "slopes", "values")):
        out[c] = [[p[i] for p in s] for s in steps]
    return out


def _unpack(r) -> Steps:
    return list(zip((int(x) for x in r.starts), (int(x) for x in r.slopes), (int(x) for x in r.values_), strict=True))


def _bundle(df: DataFrame, names: list[str]) -> DataFrame:
    """Units that belong together, by a hash, in groups of about ``TASK`` rows."""
    tasks = max(1, df.count() // TASK)
    return df.withColumn("_bundle", F.pmod(F.xxhash64(*names), F.lit(tasks)))


def _run_steps(frame: pd.DataFrame) -> pd.DataFrame:
    """The function of each run of events."""
    rows, steps = [], []
    for unit, part in frame.sort_values("_row").groupby(["user_id", "_part", "_run"], sort=False, dropna=False):
        now = SAME
        for effect, n in zip(part["effect"], part["n"], strict=True):
            now = [(0, 0, int(n))] if effect == "set" else then_debit(now, int(n)) if effect == "take" else then_add(now, int(n))
        rows.append(unit)
        steps.append(now)
    return _pack(rows, steps, ["user_id", "_part", "_run"])


def _compose_steps(frame: pd.DataFrame) -> pd.DataFrame:
    rows, steps = [], []
    frame = frame.rename(columns={"values": "values_"}).sort_values("pos")
    for (user, up), part in frame.groupby(["user_id", "_up"], sort=False):
        now = SAME
        for r in part.itertuples(index=False):
            now = compose(now, _unpack(r))
        rows.append((user, up))
        steps.append(now)
    return _pack(rows, steps, ["user_id", "pos"])


def _walk_steps(units: pd.DataFrame, starts: pd.DataFrame) -> pd.DataFrame:
    """The balance before each unit, from the one before its first."""
    begin = {(r.user_id, r.up): r.start for r in starts.itertuples(index=False)}
    out = []
    units = units.rename(columns={"values": "values_"}).sort_values("pos")
    for (user, up), part in units.groupby(["user_id", "_up"], sort=False):
        now = int(begin[user, up])
        for r in part.itertuples(index=False):
            out.append((user, r.pos, now))
            now = value_at(_unpack(r), now)
    return pd.DataFrame(out, columns=["user_id", "pos", "start"])


def starts(units: DataFrame) -> DataFrame:
    """(user_id, pos, start): the balance before each unit; units (user_id, pos from 0, a step function) of an account follow each other."""
    units = units.withColumn("_up", F.expr(f"pos div {FAN}"))
    ups = materialize(_bundle(units, ["user_id", "_up"]).groupBy("_bundle").applyInPandas(_compose_steps, f"user_id long, pos long, {_STEPS}"), "accounts-up")
    if ups.filter("pos > 0").isEmpty():
        begin = ups.select("user_id", F.lit(0).cast("long").alias("up"), F.lit(0).cast("long").alias("start"))
    else:
        begin = starts(ups).select("user_id", F.col("pos").alias("up"), "start")
    tasks = max(1, units.count() // TASK)
    of = lambda df, up: df.withColumn("_bundle", F.pmod(F.xxhash64("user_id", up), F.lit(tasks))).groupBy("_bundle")
    return of(units, "_up").cogroup(of(begin, "up")).applyInPandas(_walk_steps, "user_id long, pos long, start long")


def _apply(rows: pd.DataFrame, begin: pd.DataFrame) -> pd.DataFrame:
    """The balance after each event, and whether a debit was paid."""
    first = {(u, p, k): s for u, p, k, s in zip(begin["user_id"], begin["_part"], begin["_run"], begin["start"], strict=True)}
    out = []
    for unit, part in rows.sort_values("_row").groupby(["user_id", "_part", "_run"], sort=False):
        now = int(first[unit])
        for row, effect, n in zip(part["_row"], part["effect"], part["n"], strict=True):
            paid = effect != "take" or now >= n
            now = int(n) if effect == "set" else now + int(n) if effect == "add" else now - int(n) if paid else now
            out.append((int(row), now, paid))
    return pd.DataFrame(out, columns=["_row", "balance", "_paid"])


def walk(events: DataFrame, trial: int = K.TRIAL_PREDICTIONS) -> DataFrame:
    """Each event with status, balance, plan, expires_at and is_active after it.

    Status: "ok", "none" (a later registration), or why it was rejected: "unknown", "expired" (the debit that finds it out), "inactive", "empty".
    Null amounts count as 0, negative ones too; events without a user are unknown.
    """
    kind = F.col("kind")
    amount = F.when(kind == "activate", F.coalesce("amount", F.lit(0))).otherwise(F.greatest(F.coalesce("amount", F.lit(0)), F.lit(0))).cast("long")
    rows = events.select("user_id", "ts", "event_id", "kind", amount.alias("amount"), F.greatest(F.coalesce("days", F.lit(0)), F.lit(0)).cast("int").alias("days"), "expires_at")
    rows = in_order(rows, ["user_id"], ["ts", "event_id"], "accounts-sorted")
    rows = running(rows, ["user_id"], {"_registered": ("sum", (kind == "register").cast("long"))})
    known = F.col("user_id").isNotNull() & (F.coalesce("_registered", F.lit(0)) > 0)
    opens = (kind == "register") & (F.col("_registered") == 1) & F.col("user_id").isNotNull()
    sets = known & (kind == "activate") | opens
    paying = known & (kind == "credit")
    # the terms of a licence: the latest opening or activation, and what the payments since then add to its expiry
    rows = rows.withColumns({"_known": known, "_sets": sets, "_opens": opens, "_paying": paying})
    rows = running(rows, ["user_id"], {"_term": ("sum", F.col("_sets").cast("long"))})
    rows = running(rows, ["user_id"], {
        "_until": ("max", F.when(F.col("_sets") | (F.col("_paying") & (F.col("days") > 0)), F.struct(
            F.col("_term").alias("term"), F.when(F.col("_sets"), F.when(~F.col("_opens"), F.col("expires_at"))).otherwise(F.col("ts") + F.make_dt_interval("days")).alias("at")))),
        "_woken": ("sum", (F.col("_sets") | (F.col("_paying") & (F.col("days") > 0))).cast("long"))})
    rows = running(rows, ["user_id"], {"_prior": ("max", F.when(F.col("_sets") | (F.col("_paying") & (F.col("amount") > 0)), F.struct(
        F.col("_row").alias("row"), (F.col("_sets") & ~F.col("_opens") & (F.col("amount") == -1)).alias("unlimited"))))}, inclusive=False)
    unlimited = F.coalesce(F.col("_prior.unlimited"), F.lit(False))
    late = F.col("_known") & F.col("_until.at").isNotNull() & (F.col("ts") > F.col("_until.at"))
    debit = kind == "debit"
    rows = rows.withColumns({"_unlimited": unlimited, "_late": late & debit})
    rows = running(rows, ["user_id"], {"_found": ("max", F.when(F.col("_late"), F.col("_woken")))}, inclusive=False)
    found = F.coalesce(F.col("_found") == F.col("_woken"), F.lit(False))
    effect = (F.when(F.col("_sets"), "set").when(paying & F.col("_unlimited") & (F.col("amount") > 0), "set")
              .when(paying, "add").when(F.col("_known") & (kind == "refund") & ~F.col("_unlimited"), "add")
              .when(F.col("_known") & debit & ~F.col("_late") & ~F.col("_unlimited"), "take").otherwise("add"))
    n = (F.when(F.col("_opens"), F.lit(trial)).when(F.col("_sets"), F.col("amount")).when(effect == "set", F.col("amount") - 1)
         .when((effect == "take") | paying | (F.col("_known") & (kind == "refund") & ~F.col("_unlimited")), F.col("amount")).otherwise(F.lit(0)))
    first = rows.groupBy("_part").agg(F.min("_row").alias("_first"))
    rows = rows.withColumns({"_e": effect, "_n": n.cast("long"), "_is_found": found}).join(first, "_part").withColumn("_run", F.expr(f"(_row - _first) div {RUN}"))
    rows = materialize(rows.select("*", F.col("_e").alias("effect"), F.col("_n").alias("n")).drop("_e", "_n", "_first"), "accounts-rows")

    steps = rows.filter("user_id IS NOT NULL").select("user_id", "_part", "_run", "_row", "effect", "n")
    bundled = _bundle(steps, ["user_id", "_part", "_run"])
    units = materialize(bundled.groupBy("_bundle").applyInPandas(_run_steps, f"user_id long, _part int, _run long, {_STEPS}"), "accounts-units")
    # the place of a run in its account: runs of an account are few compared with its rows, and are numbered in ranges too
    numbered = _numbered(units)
    begin = numbered.select("user_id", "pos", "_part", "_run").join(starts(numbered.select("user_id", "pos", "starts", "slopes", "values")), ["user_id", "pos"])
    tasks = max(1, steps.count() // TASK)
    of = lambda df: df.withColumn("_bundle", F.pmod(F.xxhash64("user_id", "_part", "_run"), F.lit(tasks))).groupBy("_bundle")
    after = of(steps).cogroup(of(begin.select("user_id", "_part", "_run", "start"))).applyInPandas(_apply, "_row long, balance long, _paid boolean")
    out = rows.join(after, "_row", "left")
    status = (F.when(~F.col("_known"), "unknown").when((kind == "register") & ~F.col("_opens"), "none")
              .when(F.col("_late") & F.col("_is_found"), "inactive").when(F.col("_late"), "expired").when(~F.coalesce("_paid", F.lit(True)), "empty").otherwise("ok"))
    asleep = F.col("_late") | F.col("_is_found")
    return out.select(
        "user_id", "ts", "event_id", "kind", "amount", status.alias("status"), F.when(F.col("_known"), F.col("balance")).otherwise(F.lit(0)).cast("long").alias("balance"),
        F.when(~F.col("_known"), "").when(F.col("_term") > 1, "pro").otherwise("free").alias("plan"), F.when(F.col("_known"), F.col("_until.at")).alias("expires_at"), (F.col("_known") & ~asleep).alias("is_active"))


def _numbered(units: DataFrame) -> DataFrame:
    """Units with their place ``pos`` in the account."""
    rows = in_order(units.withColumnsRenamed({"_part": "_up", "_run": "_ur"}), ["user_id"], ["_up", "_ur"], "accounts-numbered")
    rows = running(rows, ["user_id"], {"pos": ("sum", F.lit(1).cast("long"))})
    return materialize(rows.withColumn("pos", F.col("pos") - 1).drop("_part", "_row").withColumnsRenamed({"_up": "_part", "_ur": "_run"}), "accounts-places")


def final(walked: DataFrame) -> DataFrame:
    """One row per account: its state after its last event, and how many debits were paid and rejected."""
    last = F.max(F.struct("ts", "event_id", "balance", "plan", "expires_at", "is_active")).alias("last")
    debit = F.col("kind") == "debit"
    out = walked.filter("status <> 'unknown' OR kind = 'debit'").groupBy("user_id").agg(
        last, F.count_if(debit & (F.col("status") == "ok")).alias("accepted"), F.count_if(debit & (F.col("status") != "ok")).alias("rejected"))
    return out.select("user_id", "last.balance", "last.plan", "last.expires_at", "last.is_active", "accepted", "rejected")
