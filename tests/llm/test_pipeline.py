"""The five stages on a small corpus, each against brute force on its own input."""

import random
import re

import pytest

import __spark_entry__
import corpus_pipeline
from tests.llm import test_ngram_join, test_repeats
from tests.llm.test_mixing import fixed_point

W = re.compile(r"[^\x20\x09-\x0D]+")
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def corpus(spark, make, tmp_path_factory):
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(900)}"
    passage = " ".join(word() for _ in range(64))
    item = " ".join(f"q{rng.randrange(400)}" for _ in range(30)) + ".\nThe answer is " + word()
    rows, labels = [], []
    for i in range(260):
        t = [word() for _ in range(rng.randrange(3, 90))]
        toxic = i % 4 == 0
        if toxic:
            t[rng.randrange(len(t))] = rng.choice(["vile", "nasty"])
        text = " ".join(t)
        if i % 10 == 1:
            text = f"{text}\n{passage}"
        if i % 40 == 3:
            text = f"{text} {item} tail"
        rows.append((i, text, "en", f"src{i % 5}"))
        labels.append((i, 1, int(toxic)))
    rows += [(1000 + i, rows[i][1], "en", "src1") for i in range(1, 40, 2)]
    rows += [(1100 + i, rows[i][1] + " end", "en", None) for i in range(2, 40, 4)]
    rows += [(2000, None, None, None), (2001, "", "en", "src0"), (2002, " \n", "xx", "src0")]
    path = str(tmp_path_factory.mktemp("tables"))
    make(rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(7, item), (8, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, {r[0]: r for r in rows}, item


def test_stages_on_their_own_inputs(spark, corpus, tmp_path):
    path, rows, item = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = [docs.collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, path).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append(docs.collect())
        if k < 4:
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    texts = [[(r.doc_id, r.text) for r in part] for part in seen]

    bad = {d for d, r in rows.items() if re.search(r"\b(vile|nasty)\b", r[1] or "")}
    gone = {d for d, _ in texts[0]} - {d for d, _ in texts[1]}
    assert len(gone & bad) >= 0.95 * len(bad) and len(gone - bad) <= 0.02 * len(rows)

    groups = test_ngram_join.brute(texts[1])
    assert {d for d, _ in texts[2]} == {d for d, _, c in groups if d == c} and len(texts[2]) == len({d for d, _ in texts[2]})

    cut = {(d, n - m) for d, n, m, _ in test_repeats.brute(texts[2], 50)}
    assert {(d, len(W.findall(t or ""))) for d, t in texts[3]} == cut and len(texts[3]) == len(texts[2])
    assert any(m for _, _, m, _ in test_repeats.brute(texts[2], 50))

    leaks = {d for d, t in texts[3] if item.split(".")[0] in (t or "")}
    assert {d for d, _ in texts[3]} - {d for d, _ in texts[4]} == leaks and leaks

    sizes, taken = {}, {}
    for r in seen[4]:
        sizes[r.source] = sizes.get(r.source, 0) + len(W.findall(r.text or ""))
    for r in seen[5]:
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert 1 <= r.copies <= 3 and r.taken == r.copies * r.size
    for s, t in fixed_point(sizes).items():
        assert abs(taken.get(s, 0) - t) <= max(3, 0.02 * t)


def test_run_is_registered_and_gives_the_last_stage(spark, corpus):
    path, _, _ = corpus
    out = __spark_entry__.queries()["pipeline"](spark, path)
    assert set(corpus_pipeline.COLUMNS) <= set(out.columns) and out.count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_join", "substring_dedup", "decontamination", "mixing"]
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))


def test_stages_take_an_empty_table(spark, corpus):
    path, _, _ = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, path).count() == 0
