"""The Jaccard join against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from boutlens.llm import ngram_join

W = re.compile(r"[^\x20\x09-\x0D]+")


def grams(t):
    w = W.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            k = find(i)
            least[k] = min(least.get(k, d), d)
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def corpus(seed, groups=8, size=14):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(300)}"
    rows = []
    line = [word() for _ in range(12)]
    for _ in range(groups):
        base = [word() for _ in range(rng.randrange(6, 90))]
        for _ in range(rng.randrange(1, size)):
            t = list(base)
            for _ in range(rng.randrange(0, 4)):
                t[rng.randrange(len(t))] = word()
            if rng.random() < 0.3:
                t += line
            rows.append(" ".join(t).upper() if rng.random() < 0.1 else " ".join(t))
    rng.shuffle(rows)
    out = list(enumerate(rows))
    return out + [out[0], (500, rows[1]), (501, None), (502, ""), (503, "a b"), (504, "A  b"), (505, "é"), (None, rows[2]), (None, "alone in the world here now"), (506, " ".join(line)), (1, "same id, other text of six words")]


@pytest.mark.parametrize("seed,fan,hot", [(1, 256, 8), (2, 3, 8), (3, 2, 0)])
def test_components_equal_brute_force(make, monkeypatch, seed, fan, hot):
    monkeypatch.setattr(ngram_join, "FAN", fan)
    monkeypatch.setattr(ngram_join, "HOT", hot)
    rows = corpus(seed)
    docs = make(rows).withColumn("n", F.lit("clash")).withColumn("sid", F.lit(1))
    got = ngram_join.components(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def groups(rows):
    """Components as sets of rows; rows without words are one group per id."""
    sets = [grams(t) for _, t in rows]
    out = []
    for i, (d, _) in enumerate(rows):
        linked = [g for g in out if any((sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])) or (not sets[i] and not sets[j] and d == rows[j][0]) for j in g)]
        out = [g for g in out if g not in linked] + [{i}.union(*linked)]
    return out


def test_one_row_of_each_group_stays(make):
    rows = corpus(4, groups=4, size=8) + [(502, None), (0, "unrelated text under a reused id"), (0, "yet another one with that id")]
    kept = ngram_join.representatives(make(rows).withColumn("extra", F.lit(7)).withColumn("_tid", F.lit(8)).withColumn("_mine", F.lit(9)).withColumn("comp", F.lit(1))).collect()
    assert all((r.extra, r._tid, r._mine, r.comp) == (7, 8, 9, 1) for r in kept)
    named = [(r.doc_id, r.text) for r in kept if r.doc_id is not None]
    want = [g for g in groups(rows) if any(rows[i][0] is not None for i in g)]
    for g in want:
        least = min(rows[i][0] for i in g if rows[i][0] is not None)
        mine = {rows[i] for i in g}
        assert sum(r in mine and r[0] == least for r in named) == 1, (least, mine)
    assert len(named) == len(want) and sum(d == 0 for d, _ in named) >= 2
    assert sum(r.doc_id is None for r in kept) == 2


def test_empty_table(make):
    empty = make([(1, "a")]).limit(0)
    assert ngram_join.components(empty).count() == 0 and ngram_join.representatives(empty).count() == 0


def test_filters_are_necessary_conditions(spark):
    rows = [(n, m) for n in range(1, 60) for m in range(1, 60)]
    got = spark.createDataFrame(rows, "n int, m int").select("n", "m", ngram_join.alpha(F.col("n"), F.col("m")).alias("a")).collect()
    for r in got:
        assert r.a == min(i for i in range(r.n + r.m + 1) if 100 * i >= 80 * (r.n + r.m - i))
