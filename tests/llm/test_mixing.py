"""Mixing by entropy balancing."""

import random
import re

import pytest
from pyspark.sql import functions as F

from boutlens.llm import mixing

W = re.compile(r"[^\x20\x09-\x0D]+")


def fixed_point(sizes, cap=3.0):
    """Share by weight, stop at the cap, share the excess again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, out, free = sum(sizes.values()), dict.fromkeys(order, 0.0), set(order)
    rest = float(total)
    while rest > 1e-9 and free:
        w = sum(weight[s] for s in free)
        for s in free:
            out[s] += rest * weight[s] / w
        rest = 0.0
        for s in list(free):
            if out[s] > cap * sizes[s] + 1e-9:
                rest += out[s] - cap * sizes[s]
                out[s] = cap * sizes[s]
                free.discard(s)
    return out


def corpus(seed, n=600):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = "hot" if i % 3 == 0 else rng.choice([None, "", "a", "b", "Z", "é", "tiny"]) if i % 50 else "tiny2"
        text = None if i % 97 == 0 else " ".join("w" for _ in range(int(rng.paretovariate(1)) % 400))
        rows.append((i, text, "en", source))
    return [*rows, rows[5], rows[5], *((1000 + i, "same text here", "en", "hot") for i in range(300))]


@pytest.mark.parametrize("block", [4096, 7])
def test_targets_copies_and_reruns(make, monkeypatch, block):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", block)
    rows = corpus(1)
    docs = make(rows).withColumn("size", F.lit("clash")).withColumn("_extra", F.lit(1))
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes, taken = {}, {}
    for r in got:
        n = len(W.findall(r.text or ""))
        assert r.size == n and 0 <= r.taken <= 3 * n and r.taken == r.copies * n
        sizes[r.source] = sizes.get(r.source, 0) + n
        taken[r.source] = taken.get(r.source, 0) + r.taken
    want = fixed_point(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], rel=1e-9)
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(2, 0.01 * t), (s, taken[s], t)
    key = lambda x: sorted((r.doc_id, r.size, r.taken) for r in x)
    assert key(mixing.mix(docs.repartition(5)).collect()) == key(got)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "a b c", "en", None)], [(None, "a b"), (None, "a b")]])
def test_small_tables(make, rows):
    got = mixing.mix(make(rows)).collect()
    assert len(got) == len(rows) and all(r.taken <= 3 * r.size for r in got)


def test_columns_of_any_name_come_back(make):
    names = ["n", "copies_all", "rate", "_s", "_h", "_block", "_rank", "_before", "_in", "_blocks", "weight", "caller_0", "a`b.c", "m"]
    docs = make(corpus(2, 60))
    for k, name in enumerate(names):
        docs = docs.withColumn(name, F.lit(f"kept {k}"))
    got = mixing.mix(docs)
    assert got.columns == [*docs.columns, *mixing.RESULT]
    rows = got.collect()
    assert len(rows) == docs.count() and all(r[name] == f"kept {k}" for r in rows for k, name in enumerate(names))
    key = lambda x: sorted((r.doc_id, r.size, r.taken) for r in x)
    assert key(rows) == key(mixing.mix(make(corpus(2, 60))).collect())
