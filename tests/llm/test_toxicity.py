"""The toxicity classifier."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from boutlens.llm import toxicity


def corpus(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "de"])
        y = int(rng.random() < 0.3)
        w = [f"{lang}{rng.randrange(400)}" for _ in range(rng.randrange(5, 120))]
        if y:
            for _ in range(rng.randrange(1, 4)):
                w.insert(rng.randrange(len(w)), rng.choice(["vile", "nasty,"]) if lang == "en" else "schlimm" + rng.choice(["er", "e", f"es{rng.randrange(99)}"]))
        rows.append((i, " ".join(w), lang, y))
    return rows


def test_held_out_accuracy_and_split(make, spark):
    rows = corpus(900, 1)
    docs, labels = make([r[:3] for r in rows]), spark.createDataFrame([(r[0], 1, r[3]) for r in rows] + [(None, 1, 1), (99999, 0, 1), (1, 0, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).withColumn("train", toxicity.in_training()).collect()
    held = [r for r in got if not r.train]
    assert all(r.train == (zlib.crc32(str(r.doc_id).encode()) % 3 != 1) for r in got)
    truth = {r[0]: r[3] for r in rows}
    right = [int(r.score >= 0.7) == truth[r.doc_id] for r in held]
    assert np.mean(right) >= 0.95 and all(0 <= r.score <= 1 for r in got) and set(model.thresholds) == {"en", "de"}
    again = toxicity.score(docs.repartition(7), toxicity.fit(docs, labels)).collect()
    assert sorted((r.doc_id, r.score) for r in again) == sorted((r.doc_id, r.score) for r in got)


def test_labels_of_held_out_rows_are_never_read(make, spark):
    rows = corpus(300, 2)
    docs = make([r[:3] for r in rows])
    lab = lambda flip: spark.createDataFrame([(r[0], 1, 1 - r[3] if flip and zlib.crc32(str(r[0]).encode()) % 3 == 1 else r[3]) for r in rows], "doc_id long, quality int, toxic int")
    one, two = toxicity.fit(docs, lab(False)), toxicity.fit(docs, lab(True))
    assert np.array_equal(one.table, two.table) and one.thresholds == two.thresholds


def test_long_texts_in_blocks_equal_one_block(monkeypatch):
    rows = corpus(60, 3)
    model = toxicity.train([r[1] for r in rows], [r[3] for r in rows])
    text = " ".join(r[1] for r in rows)
    whole = model.score(text)
    monkeypatch.setattr(toxicity, "BLOCK_WORDS", 7)
    assert model.score(text) == pytest.approx(whole, abs=1e-5)


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)], [(1, 1, 1)]])
def test_edge_rows(make, spark, labels):
    docs = make([(1, "a b"), (2, None), (3, ""), (3, ""), (None, "x"), (4, "w " * 50_000)]).withColumn("score", F.lit("clash"))
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = toxicity.score(docs, model).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_every_labelled_row_counts(make, spark):
    """More rows of a class than any sample held: the last ones, by the hash of their ids, still decide, in one group and in many."""
    rows = [(i, f"common word{i % 50} " + ("vile" if i % 2 == 0 else "fine"), "en", int(i % 2 == 0)) for i in range(8000)]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    known = docs.where(toxicity.in_training()).select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h").collect()
    late = {r.doc_id for r in known[-400:]}
    rows = [(i, "common raremark" if i in late else t, lang, 1 if i in late else y) for i, t, lang, y in rows]
    docs = make([r[:3] for r in rows])
    labels = spark.createDataFrame([(r[0], 1, r[3]) for r in rows], "doc_id long, quality int, toxic int")
    train = docs.where(toxicity.in_training()).join(labels.withColumnRenamed("toxic", "y"), "doc_id").select("doc_id", "text", "lang", "y")
    for model in (toxicity.fit_rows(train), toxicity.fit_rows(train, group_rows=700)):
        assert model.score("common raremark") > 0.7 > 0.5 > model.score("common word3 fine")
    again = toxicity.fit_rows(train.repartition(5), group_rows=700)
    assert np.array_equal(again.table, model.table) and again.bias == model.bias


def test_thresholds_equal_a_replay(spark):
    rng = random.Random(4)
    rows = [(lang, round(rng.random(), 2), int(rng.random() < 0.4)) for lang in ["en"] * 300 + ["de"] * 200 + ["few"] * 30 + [None] * 40]
    want = {}
    for lang in ("en", "de"):
        own = [(s, y) for x, s, y in rows if x == lang]
        at = sorted({s for s, _ in own}, reverse=True)
        f1 = [2 * sum(y for s, y in own if s >= t) / (sum(s >= t for s, _ in own) + sum(y for _, y in own)) for t in at]
        k = f1.index(max(f1))
        want[lang] = (at[k] + (at[k + 1] if k + 1 < len(at) else 0.0)) / 2
    assert toxicity.thresholds(spark.createDataFrame(rows, "lang string, score double, y int")) == pytest.approx(want)


def test_labels_are_merged_also_where_they_are_few(make, spark):
    docs = make([(i, f"text {i}", "en") for i in range(20)])
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(15)] * 2, "doc_id long, quality int, toxic int")
    rows = toxicity.training_rows(docs, labels)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert sorted(r.doc_id for r in rows.collect()) == [i for i in range(15) if zlib.crc32(str(i).encode()) % 3 != 1]


def test_short_texts_are_handled_many_at_once(monkeypatch):
    """Calls grow with words, not with texts."""
    rows = corpus(1500, 5)
    calls = {"hashes": 0, "embed": 0}
    hashes_to, embed = toxicity.words.hashes_to, toxicity.Model.embed

    def counted(name, f):
        def g(*args):
            calls[name] += 1
            return f(*args)

        return g

    monkeypatch.setattr(toxicity.words, "hashes_to", counted("hashes", hashes_to))
    monkeypatch.setattr(toxicity.Model, "embed", counted("embed", embed))
    toxicity.train([r[1] for r in rows], [r[3] for r in rows])
    n_bytes, n_batches = sum(len(r[1]) for r in rows), -(-len(rows) // toxicity.BATCH)
    assert calls["hashes"] <= n_bytes / (1 << 15) + 1
    assert calls["embed"] <= 3 * toxicity.EPOCHS * n_batches


def test_texts_at_once_score_as_alone():
    rows = corpus(200, 6)
    model = toxicity.train([r[1] for r in rows], [r[3] for r in rows])
    texts = [None, "", "a", " ., ", "Vile", "vile nasty,", *[r[1] for r in rows], "ÜBEL schlimm\tvile", "w " * 9000 + "vile", *[""] * 9000, "vile\nx"]
    got = model.scores(texts)
    assert got == [model.score(t) for t in texts] and model.scores([]) == []
    assert got[-1] > got[0]


def plainly(model, rows, y, share, epochs):
    """The fit, text by text and filter by filter."""
    rng, bias = np.random.default_rng(1), np.array([model.bias], np.float32)
    params = [*model.filters, model.shift, model.weight, bias]
    adam, squares = toxicity.Adam(*(p.shape for p in params)), np.full(toxicity.ROWS, 1e-6, np.float32)
    for epoch in range(epochs):
        order, rate = rng.permutation(len(y)), toxicity.RATE * (1 - epoch / epochs)
        for b in range(0, len(order), toxicity.BATCH):
            grads, pulls = [np.zeros_like(p) for p in params], {}
            for i in order[b : b + toxicity.BATCH]:
                x, won = model.table[rows[i]].mean(axis=1), []
                for k, c in np.ndindex(len(toxicity.WIDTHS), toxicity.FILTERS):
                    f = model.filters[k][:, :, c]
                    z = [float((x[a : a + len(f)] * f).sum()) + model.shift[k * toxicity.FILTERS + c] for a in range(len(x) - len(f) + 1)]
                    a = int(np.argmax(z)) if z else 0
                    won.append((k, c, a, z[a]) if z and z[a] > 0 else (k, c, -1, 0.0))
                best = np.array([v for *_, v in won])
                d = 1 / (1 + np.exp(-(best @ model.weight + bias[0]))) - y[i]
                d *= (0.5 / share if y[i] else 0.5 / (1 - share)) / toxicity.BATCH
                grads[-2] += (d * best).astype(np.float32)
                grads[-1] += np.float32(d)
                for j, (k, c, a, _) in enumerate(won):
                    if a >= 0:
                        f = model.filters[k][:, :, c]
                        grads[k][:, :, c] += d * model.weight[j] * x[a : a + len(f)]
                        grads[-3][j] += d * model.weight[j]
                        for t, tap in enumerate(f.copy()):
                            for r in rows[i][a + t]:
                                pulls[r] = pulls.get(r, 0) + d * model.weight[j] * tap / rows[i].shape[1]
            adam.step(params, grads, rate)
            for r, g in pulls.items():
                squares[r] += (g * g).mean()
                model.table[r] -= 4 * rate * g / np.sqrt(squares[r])
    return model, float(bias[0])


def test_fit_equals_a_plain_replay(monkeypatch):
    monkeypatch.setattr(toxicity, "EPOCHS", 1)
    rows = corpus(70, 7)
    texts, y = [*[" ".join(r[1].split()[-9:]) for r in rows], "", None, "vile", "vile a"], np.array([*[r[3] for r in rows], 0, 0, 1, 1], np.float32)
    found = [p for (p,) in map(toxicity.pieces, [[t] for t in texts])]
    start = lambda: toxicity.begin(toxicity.count_pieces(found, y), float((y == 0).sum()), float(y.sum()))
    held = np.zeros((2, toxicity.ROWS))
    for p, c in zip(found, y, strict=True):
        for r in set(p.ravel().tolist()):
            held[int(c), r] += 1
    assert np.array_equal(toxicity.count_pieces(found, y), held)
    got = toxicity.descend(start(), found, y, float(y.mean()))
    want, bias = plainly(start(), found, y, float(y.mean()), 1)
    for a, b in zip([*got.filters, got.shift, got.weight, got.bias, got.table], [*want.filters, want.shift, want.weight, bias, want.table], strict=True):
        assert np.allclose(a, b, rtol=1e-3, atol=1e-4)
