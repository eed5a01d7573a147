"""The manifest of documents: midstates, proofs and folded roots."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from boutlens.llm import manifest

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def cell(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def climb(tree, i, value):
    """Root with ``value`` at place i, and the siblings on the way."""
    siblings = []
    for level in tree[:-1]:
        run = level[i // 16 * 16 : i // 16 * 16 + 16]
        siblings += run[: i % 16] + run[i % 16 + 1 :]
        run[i % 16] = value
        value, i = sha("".join(run)), i // 16
    return value, siblings


def brute(rows):
    """Rows (doc_id, text, lang, source, n_chars) -> sorted results."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    leaf = lambda d, t, la, s, n: sha(cell(d) + cell(s) + cell(la) + cell(n) + cell(t))
    by = {}
    for d, t, la, s, n in rows:
        bad = d is not None and zlib.crc32(str(d).encode()) % 5 == 0
        by.setdefault(s, []).append((d is not None, d or 0, leaf(d, t, la, s, n), leaf(d, t and t.translate(low), la, s, n) if bad else None))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = [levels([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in order]
    top = levels([t[-1][0] for t in trees])
    out = []
    for k, s in enumerate(order):
        for i, (known, d, own, other) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            sub, left = climb(trees[k], i, other or own)
            root, above = climb(top, k, sub)
            out.append((d if known else None, own, trees[k][-1][0], top[-1][0], sha("".join(left + above)), root, root == top[-1][0]))
    return sorted(out, key=repr)


def test_midstates_are_those_of_the_hash():
    rng = np.random.default_rng(1)
    for n in (1, 2, 15, 16):
        children = rng.integers(0, 256, (n, 32), dtype=np.uint8)
        text = [c.tobytes().hex() for c in children]
        up, before = manifest.parents(children, np.array([0]), np.array([n]))
        assert up[0].tobytes().hex() == sha("".join(text))
        value = rng.integers(0, 256, (1, 32), dtype=np.uint8)
        for i in range(n):
            got = manifest.fold(value, before[[i]], children, np.array([i]), np.array([n]), np.array([n]))
            assert got[0].tobytes().hex() == sha("".join([*text[:i], value[0].tobytes().hex(), *text[i + 1 :]]))


def corpus():
    rng = random.Random(3)
    rows = []
    for i in range(900):
        source = "hot" if i % 2 else rng.choice([None, "", "Z", "é", "😀", "a", *(f"s{k}" for k in range(40))])
        rows.append((None if i % 131 == 0 else i, rng.choice([None, "", "Some TEXT", "lower only", "ÄÖ Grün\n" * 9]) if i % 9 else "Long TEXT " * 20000, "en" if i % 7 else None, source))
    return [*rows, rows[7], rows[7], *((5, f"Same id {k}", "en", "hot") for k in range(30))]


def check(make, rows):
    docs = make(rows).withColumn("leaf", F.lit("clash")).withColumn("_part", F.lit(1)).withColumn("tree", F.lit(2))
    got = manifest.verify(docs.repartition(5), manifest.tampered(), manifest.lowered(F.col("text"))).collect()
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1]) if r[1] is not None else None) for r in rows]
    assert sorted(map(tuple, got), key=repr) == brute(full)


def test_all_rows_against_brute_force(make):
    check(make, corpus())


@pytest.mark.parametrize("rows", [[], [(5, None)], [(None, "A b"), (None, "A b")], [(k, "X") for k in range(17)], [(k, "X", "en", str(k)) for k in range(17)], [(k, "Y") for k in range(257)]])
def test_small_tables(make, rows):
    check(make, rows)


def test_large_ids_stay_whole(make):
    ids = [2**53 + 1, 2**62 + 3, -(2**62) - 1, None]
    got = manifest.verify(make([(i, "t") for i in ids]), F.lit(False), F.col("text")).collect()
    assert {r.doc_id for r in got} == set(ids) and all(r.verified for r in got)
