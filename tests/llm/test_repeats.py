"""Substring dedup by both methods against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from boutlens.llm import repeats, substring_dedup, suffix_dedup, words

W = re.compile(r"[^\x20\x09-\x0D]+")
METHODS = [substring_dedup, suffix_dedup]


def brute(rows, window):
    first = {}
    for d, t in rows:
        w = W.findall(t or "")
        for i in range(len(w) - window + 1):
            if d is not None:
                k = tuple(w[i : i + window])
                first[k] = min(first.get(k, d), d)
    out = []
    for d, t in rows:
        w = W.findall(t or "")
        gone = set()
        for i in range(len(w) - window + 1):
            if d is not None and first[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed, n=40, window=12):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)] + ["é", "日本"]
    text = lambda k: [rng.choice(vocab) for _ in range(k)]
    passages = [text(rng.randrange(window, 3 * window)) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            p = list(rng.choice(passages)) if rng.random() < 0.6 else text(rng.randrange(20))
            if rng.random() < 0.3 and p:
                p[rng.randrange(len(p))] = "edit"
            parts += p[rng.randrange(3) :] if rng.random() < 0.4 else p
        rows.append((i, rng.choice([" ", "\n", "  "]).join(parts)))
    rows += [(100 + i, rows[i][1]) for i in range(5)] + [(3, rows[3][1])]
    return rows + [(200, None), (201, ""), (202, "a " * 90), (203, "a " * 70), (None, rows[0][1]), (204, "a b " * 60)]


@pytest.mark.parametrize("method", METHODS)
@pytest.mark.parametrize("seed", [1, 2])
def test_spans_equal_brute_force(make, method, seed, monkeypatch):
    if seed == 2:  # the path of anchors that one shard can't hold
        monkeypatch.setattr(repeats, "ANCHOR_PIECES", 1)
    rows, window = corpus(seed), 12
    docs = make(rows).withColumn("anchor", F.lit("clash"))
    match = method.match if method is substring_dedup else lambda *a: suffix_dedup.match(*a, gram=5)
    spans = repeats.repeated_spans(docs, match, window, gram=5)
    got = repeats.digest(repeats.with_spans(docs, spans)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=repr) == brute(rows, window)


def test_matchers_agree_with_a_direct_comparison():
    rng = random.Random(5)
    window, gram = 12, 5
    runs, owners, anchors, want = [], [], [], []
    for i in range(120):
        h = words.text_hashes(" ".join(rng.choice("ab") if rng.random() < 0.9 else f"z{i}" for _ in range(40)))
        for f, n, place, anchor in zip(*repeats.cut(h, window, gram), strict=True):
            runs.append(h[f : f + n + window - 1])
            owners.append(i // 2)
            anchors.append(anchor.astype(np.uint64).view(np.int64))
    first = {}
    for r, d in zip(runs, owners, strict=True):
        for i in range(len(r) - window + 1):
            k = r[i : i + window].tobytes()
            first[k] = min(first.get(k, d), d)
    want = [[i for i in range(len(r) - window + 1) if first[r[i : i + window].tobytes()] < d] for r, d in zip(runs, owners, strict=True)]
    one = substring_dedup.match(runs, np.array(owners), np.array(anchors), window)
    two = suffix_dedup.match(runs, np.array(owners), np.array(anchors), window, gram=gram)
    assert [x.tolist() for x in one] == want and [x.tolist() for x in two] == want and any(want)


@pytest.mark.parametrize("method", METHODS)
def test_dedup_cuts_planted_passages_and_keeps_the_rest(make, method):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage = " ".join(word() for _ in range(60))
    clean = [" ".join(word() for _ in range(80)) for _ in range(6)]
    rows = [(i, f"{c}\n{passage} end{i}" if i % 2 else c) for i, c in enumerate(clean)]
    out = {r.doc_id: r.text for r in method.dedup(make(rows)).collect()}
    assert out[1] == rows[1][1] and out[0] == clean[0] and out[2] == clean[2]
    assert out[3] == f"{clean[3]}\nend3" and out[5] == f"{clean[5]}\nend5"


def test_empty_table(make):
    empty = make([(1, "a")]).limit(0)
    assert substring_dedup.dedup(empty).count() == 0 and suffix_dedup.dedup(empty).count() == 0


def test_against_a_bounded_reference(make, spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 30)
    rng = random.Random(4)
    ref = [" ".join(f"r{rng.randrange(50)}" for _ in range(25)) for _ in range(4)]
    docs = make([(1, "x y " + ref[2] + " z"), (2, "q " * 40), (3, None)])
    reference = spark.createDataFrame([(t,) for t in ref], "text string")
    got = {(r.doc_id, r.start, r.end) for r in substring_dedup.against(docs, reference, window=20).collect()}
    assert got == {(1, 2 + i, 22 + i) for i in range(6)}
    with pytest.raises(ValueError):
        substring_dedup.against(docs, reference, max_words=1)
