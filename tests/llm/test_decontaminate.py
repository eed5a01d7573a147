"""Decontamination: the index, block-max WAND and verified pairs against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from boutlens.llm import decontaminate as dc


def build(seed, n=60):
    rng = random.Random(seed)
    vocab = [f"v{int(rng.paretovariate(0.7)) % 500}" for _ in range(3000)]
    text = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    items = [(i, text(rng.randrange(8, 40)) + ".\n" + text(rng.randrange(2, 8))) for i in range(n)] + [(n, text(150) + ". " + text(9)), (n + 1, "one"), (n + 2, "")]
    df, total, size = {}, 0, 0
    for _, t in items:
        for q, a in dc.entries(t):
            h = np.concatenate([q, a])
            total, size = total + 1, size + len(h)
            for x in set(h.tolist()):
                df[x] = df.get(x, 0) + 1
    return rng, text, items, dc.Index.of(items, df, total, size / total)


@pytest.mark.parametrize("seed", range(4))
def test_wand_returns_all_entries_above_the_goal(seed, monkeypatch):
    monkeypatch.setattr(dc, "BLOCK_POSTINGS", 3)
    rng, _, _, index = build(seed)
    for k in range(60):
        query = np.sort(np.array(rng.sample(range(len(index.vocabulary)), min(len(index.vocabulary), 5 + 3 * k))))
        full = np.zeros(len(index.items))
        for t in query:
            s = slice(index.at[t], index.at[t + 1])
            full[index.entry[s]] += index.weight[s]
        for goal in (1.0, 0.5, 0.2):
            got = dict(index.wand(query, goal))
            assert set(got) == set(np.flatnonzero(full >= goal).tolist())
            assert all(got[e] == pytest.approx(full[e]) for e in got)


def test_planted_items_are_found_and_clean_documents_are_not(spark, make):
    rng, text, items, _ = build(7)
    docs, want = [], set()
    for i in range(80):
        body = [f"clean{rng.randrange(9)}" + text(1) for _ in range(rng.randrange(0, 700))]
        if i % 2 and items[i % 60][1]:
            leak = items[i % 60][1].upper().split() if i % 4 == 1 else items[i % 60][1].split()
            body[len(body) // 3 : len(body) // 3] = leak
            want.add((i, i % 60))
        docs.append((i, " ".join(body)))
    docs += [(900, items[60][1]), (901, None), (902, ""), (None, items[3][1])]
    frame = make(docs).withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame([*items, (None, "x y z"), (999, None)], "item_id long, text string")
    got = [(r.doc_id, r.item_id) for r in dc.contaminated(frame, bench).collect()]
    assert set(got) == want | {(900, 60), (None, 3)} and len(got) == len(set(got))
    kept = {r.doc_id for r in dc.clean(frame, bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in got}


def test_shards_and_empty_tables(spark, make, monkeypatch):
    _, _, items, _ = build(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = make([(i, "x " + t) for i, t in items])
    key = lambda d: sorted((r.doc_id, r.item_id, round(r.score, 9)) for r in d.collect())
    whole = key(dc.contaminated(docs, bench))
    monkeypatch.setattr(dc, "SHARD_WORDS", 400)
    assert key(dc.contaminated(docs, bench)) == whole and len(whole) >= 60
    assert dc.contaminated(docs, bench.limit(0)).count() == 0 and dc.clean(docs, bench.limit(0)).count() == len(items)
    assert dc.contaminated(docs.limit(0), bench).count() == 0
