"""Quality rules and token counts."""

import functools
import random
import re

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from boutlens.llm import quality, tokens, words

W = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = [None, "", " \n ", "one", "a b\x1cc d", "x " * 5000, "a b c d e f g h " * 3, "line\nline\n\nline", "é" * 70000, "<|endoftext|>", "a<|endoftext|>b  c\n\n d", "#*$ %&|<>", "𝒳𝒴 🙂🙂 don't we'll", " \t\n"]


def brute(t):
    t = t or ""
    ws = W.findall(t)
    lines = [x for x in t.split("\n") if W.search(x)]
    grams = [tuple(ws[i : i + 8]) for i in range(len(ws) - 7)]
    seen = {}
    for g in grams:
        seen[g] = seen.get(g, 0) + 1
    covered = {j for i, g in enumerate(grams) if seen[g] > 1 for j in range(i, i + 8)}
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_equal_brute_force(make):
    rng = random.Random(1)
    texts = EDGE + [" ".join(rng.choice("abc") for _ in range(rng.randrange(60))) + rng.choice(["", "\nx\nx"]) for _ in range(60)]
    rows = list(enumerate(texts)) + [(0, None)]
    got = quality.judge(make(rows).withColumn("m2", F.lit(1)).withColumn("n_words", F.lit("clash")))
    found = got.select("doc_id", "m.n_words", "m.word_chars", "m.n_symbols", "m.n_dup_lines", "m.n_repeat_words", "base_failed", "kept").collect()
    assert len(found) == len(rows)
    for r in found:
        want = brute(texts[r[0]])
        assert tuple(r)[1:6] == want, texts[r[0]]
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)


def test_quality_runs_no_python_and_no_shuffle(make):
    plan = quality.judge(make([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_quality_of_an_empty_table(make):
    assert quality.judge(make([(1, "a")]).limit(0)).count() == 0


@functools.cache
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_token_counts_equal_the_library(spark, sf, make):
    texts = EDGE + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    rows = tokens.count_tokens(make(list(enumerate(texts)))).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()
    lib = library()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r.doc_id] or ""
        n = len(lib.encode(t, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 1024)


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_any_text_has_the_count_of_the_library(text):
    assert tokens.counter(public_tokenizers.path("byte_bpe_50k.json")).count(text) == len(library().encode(text, add_special_tokens=False).ids)


def test_equal_words_have_equal_hashes_wherever_they_stand():
    text = "x" * 200_000 + " aa bb aa " + "é" * 70_000 + " aa  " + "y " * 200_000 + "aa"
    ws, h = W.findall(text), words.text_hashes(text)
    assert len(ws) == len(h)
    by = {}
    for w, x in zip(ws, h.tolist(), strict=True):
        by.setdefault(w, set()).add(x)
    assert all(len(v) == 1 for v in by.values()) and len({min(v) for v in by.values()}) == len(by)
    s = words.Sequence(h)
    assert len(np.unique(s.grams(3))) == len({tuple(ws[i : i + 3]) for i in range(len(ws) - 2)})


def test_quality_gives_columns_of_any_name_back(make):
    names = ["_w", "_lines", "_win", "_twice", "_order", "_places", "M", "Kept", "caller_0"]
    docs = make([(1, "a b c " * 20), (2, None)])
    for name in names:
        docs = docs.withColumn(name, F.lit("mine"))
    got = quality.judge(docs)
    kept = [c for c in docs.columns if c.lower() not in quality.RESULT]
    assert got.columns == [*kept, *quality.RESULT]
    assert all(r[c] == "mine" for r in got.collect() for c in names if c in kept)
    plain = {r.doc_id: r.m for r in quality.judge(make([(1, "a b c " * 20), (2, None)])).collect()}
    assert {r.doc_id: r.m for r in got.collect()} == plain
