"""The tree of beginnings of conversations."""

import hashlib
import random
import zlib

import pytest

from boutlens.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, length string, ka string, _part string"


def brute(rows):
    name = lambda r: (hashlib.md5(f"{len((r[2] or '').encode())}:{r[2] or ''}{r[3] or ''}".encode()).digest())
    signed = lambda d: tuple(int.from_bytes(d[i : i + 8], "big", signed=True) for i in (0, 8))
    own = {}
    for r in rows:
        if r[0] is not None:
            own.setdefault(r[0], []).append(((r[1] is not None, r[1] or 0, signed(name(r))), (r[2] or "", r[3] or "")))
    own = {c: [t for _, t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - c % 5 if c >= 0 else c + -c % 5
        built[c] = own.get(base, [])[:h] + own[c][h:]
    members = {}
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    kids = {}
    for w in members:
        if w:
            kids.setdefault(w[:-1], []).append(w)
    leaves, saved = {}, {}
    for w in sorted(members, key=len, reverse=True):
        below = kids.get(w, [])
        leaves[w] = sum(leaves[k] for k in below) or 1
        saved[w] = sum(saved[k] for k in below) + (len(members[w]) - 1) * (len(w[-1][1].encode()) if w else 0)
    out = []
    for w, ms in members.items():
        ending = ",".join(str(c) for c in sorted(ms) if len(built[c]) == len(w))
        out.append((min(ms), len(w), min(members[w[:-1]]) if w else None, len(ms), len(kids.get(w, [])), leaves[w], saved[w], hashlib.sha256(ending.encode()).hexdigest()))
    return sorted(out, key=repr)


def check(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    got = trie.prefix_tree(df.repartition(5))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def corpus(seed):
    rng = random.Random(seed)
    rows = []
    for c in range(-11, 160):
        if c % 10 == 0 and rng.random() < 0.5:
            continue
        alike = rng.choice(["a", "b"]) if c % 3 else "same"
        for t in range(0 if c % 13 == 0 else rng.randint(1, 14)):
            role = None if t % 5 == 4 else rng.choice(["user", "assistant"]) if alike != "same" else "user"
            text = rng.choice([None, "", "ü", "x" * 40]) if alike == "b" else f"{alike} {t}"
            rows.append((c, None if t == 3 else t - t % 2, role, text))
    rows += [(77, t, "user", f"turn {t % 3}") for t in range(400)]
    rows += [(76, t, "user", f"turn {t % 3}") for t in range(390)]
    rows += [(1000 + c, t, "user", "system prompt" if t == 0 else f"{c}") for c in range(300) for t in range(2)]
    return [*rows, rows[5], rows[5], (None, 1, "user", "left out"), (2000, 0, "user", "long " * 40000), (500, 1, "user", "ab"), (501, 1, "use", "rab")]


@pytest.mark.parametrize("width,chunk", [(8, 4096), (3, 5)])
def test_all_nodes_against_brute_force(spark, monkeypatch, width, chunk):
    monkeypatch.setattr(trie, "WIDTH", width)
    monkeypatch.setattr(trie, "CHUNK", chunk)
    check(spark, corpus(width))


@pytest.mark.parametrize("rows", [[], [(None, 1, "a", "b")], [(4, None, None, None)], [(5, 1, "u", "t")] * 3, [(1, 0, "u", "x"), (2, 0, "u", "x"), (3, 0, "u", "x")]])
def test_small_tables(spark, rows):
    check(spark, rows)


def test_one_rollup_makes_all_depths(spark):
    rows = spark.createDataFrame([(1, t, "u", str(t)) for t in range(60)], "conv_id long, turn long, role string, text string")
    plan = trie.rollup(trie.blocks(*trie.rebuild(rows)), "count(*) AS n")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Expand") == 1 and plan.count("Aggregate") == 1
