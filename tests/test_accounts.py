"""Accounts with all rules against a walk event by event."""

import datetime as dt
import random

import pytest

from boutlens.operators import accounts as A

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "user_id long, ts timestamp, event_id long, kind string, amount long, days int, expires_at timestamp"


def replay(rows, trial=20):
    """The rules one by one."""
    state, out = {}, {}
    for user, ts, i, kind, amount, days, expires in sorted(rows, key=lambda r: (r[1], r[2])):
        n, days = (amount or 0) if kind == "activate" else max(amount or 0, 0), max(days or 0, 0)
        s = state.get(user) if user is not None else None
        status = "ok"
        if kind == "register" and user is not None:
            if s is None:
                s = state[user] = {"balance": trial, "plan": "free", "expires": None, "active": True}
            else:
                status = "none"
        elif s is None:
            status = "unknown"
        elif kind == "activate":
            s.update(plan="pro", balance=n, expires=expires, active=True)
        elif kind == "debit":
            if not s["active"]:
                status = "inactive"
            elif s["expires"] is not None and ts > s["expires"]:
                s["active"], status = False, "expired"
            elif s["balance"] == -1:
                pass
            elif s["balance"] >= n:
                s["balance"] -= n
            else:
                status = "empty"
        elif kind == "refund":
            if s["balance"] != -1:
                s["balance"] += n
        elif kind == "credit":
            s["balance"] += n
            if days:
                new = ts + dt.timedelta(days=days)
                s["expires"] = max(s["expires"], new) if s["expires"] else new
                s["active"] = True
        out[i] = (status, *((s["balance"], s["plan"], s["expires"], s["active"]) if s else (0, "", None, False)))
    return out


def history(seed, n, users, hot=None):
    rng, rows = random.Random(seed), []
    for i in range(n):
        ts = T0 + dt.timedelta(hours=i // 2)
        kind = rng.choices(["register", "activate", "debit", "refund", "credit"], [1, 1, 14, 2, 2])[0]
        amount = {"activate": rng.choice([-1, 3, 8, 0]), "debit": rng.choice([1, 1, 1, 5, 2, None, -3]), "refund": 1, "credit": rng.choice([0, 1, 6])}.get(kind)
        expires = ts + dt.timedelta(hours=rng.randrange(0, 90)) if kind == "activate" and rng.random() < 0.7 else None
        user = hot if hot is not None and rng.random() < 0.6 else rng.choice([*range(users), None] if rng.random() < 0.05 else range(users))
        rows.append((user, ts, i, kind, amount, rng.choice([0, 0, 1, 2]) if kind == "credit" else None, expires))
    return rows


def test_step_functions_compose():
    rng = random.Random(2)
    for _ in range(200):
        moves = [(rng.choice(["take", "add", "take", "set"][: rng.choice([3, 4])]), rng.randrange(0, 7)) for _ in range(rng.randrange(1, 14))]
        cut = rng.randrange(len(moves) + 1)
        halves = []
        for part in (moves[:cut], moves[cut:]):
            now = A.SAME
            for effect, n in part:
                now = [(0, 0, n)] if effect == "set" else A.then_debit(now, n) if effect == "take" else A.then_add(now, n)
            halves.append(now)
        whole = A.compose(*halves)
        for b in range(60):
            want = b
            for effect, n in moves:
                want = n if effect == "set" else want + n if effect == "add" else want - n if want >= n else want
            assert A.value_at(whole, b) == A.value_at(halves[1], A.value_at(halves[0], b)) == want
    units = A.SAME
    for _ in range(500):
        units = A.then_debit(units, 1)
    assert len(units) <= 3


@pytest.mark.parametrize("run,fan,hot", [(4096, 1024, None), (7, 3, 2)])
def test_every_event_equals_the_replay(spark, monkeypatch, run, fan, hot):
    monkeypatch.setattr(A, "RUN", run)
    monkeypatch.setattr(A, "FAN", fan)
    monkeypatch.setattr(A, "TASK", 200)
    rows = history(run, 900, 12, hot)
    random.Random(1).shuffle(rows)
    got = A.walk(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert {r.event_id: (r.status, r.balance, r.plan, r.expires_at, r.is_active) for r in got} == replay(rows)
    seen = {r.status for r in got}
    assert seen == {"ok", "none", "unknown", "expired", "inactive", "empty"} and len(got) == len(rows)


def test_a_large_debit_is_rejected_and_no_rows_give_none(spark):
    rows = [(1, T0, 0, "register", None, None, None), (1, T0 + dt.timedelta(1), 1, "debit", 17, None, None), (1, T0 + dt.timedelta(2), 2, "debit", 5, None, None), (1, T0 + dt.timedelta(3), 3, "debit", 3, None, None)]
    walked = A.walk(spark.createDataFrame(rows, SCHEMA))
    assert [(r.status, r.balance) for r in walked.orderBy("event_id").collect()] == [("ok", 20), ("ok", 3), ("empty", 3), ("ok", 0)]
    assert tuple(A.final(walked).first()) == (1, 0, "free", None, True, 2, 1)
    assert A.walk(spark.createDataFrame([], SCHEMA)).collect() == []
