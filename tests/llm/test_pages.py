"""Main text of pages."""

import html
import itertools
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from boutlens.llm import pages


def article(page):
    """The text of the article element of a page of the test tables."""
    s = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    return " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1)>|<br>", " ", s))).split())


@pytest.fixture(scope="module")
def real(spark, sf):
    return [r.html for r in spark.read.parquet(f"{sf}/../sf0.01/pages.parquet").orderBy("page_id").collect()]


@pytest.fixture(scope="module")
def model(real):
    return pages.train(real[:100])


def test_articles_of_pages_not_trained_on(real, model):
    got = model.texts(real[100:])
    assert np.mean([g == article(p) for g, p in zip(got, real[100:], strict=True)]) >= 0.99


def test_other_layouts(real, model):
    rng, good = random.Random(5), 0
    for page in real[100:160]:
        blocks = pages.tree(page)
        labels = pages.truth(blocks)
        inside, outside = ([r[1] for b in blocks for r in b.runs if labels[b.number] == k] for k in (1, 0))
        other = pages.dressed(inside, outside, rng)
        made, own = pages.marked(other)
        want = " ".join(r[1] for r in sorted(r for b in made if own[b.number] == 1 for r in b.runs))
        good += model.texts([other.replace(' id="y"', "")])[0] == want
    assert good >= 54


def test_the_tree_of_broken_markup():
    page = "<html><body><p>a<b>b</b> c<p>d<br>e<div>f<ul><li>g<li>h</ul></span>i</div><!-- x <p>no</p> --><script>var t='</p>';</script>j &amp; k&nbsp;l<style>q"
    blocks = pages.tree(page)
    runs = sorted(r for b in blocks for r in b.runs)
    assert [r[1] for r in runs] == ["ab c", "d e", "f", "g", "h", "i", "j & k l"]
    by = {r[1]: b.tag for b in blocks for r in b.runs}
    assert by["ab c"] == by["d e"] == "p" and by["i"] == by["f"] == "div" and by["h"] == "li" and by["j & k l"] == "body"


@pytest.mark.parametrize("seed", range(6))
def test_decoding_is_the_best_consistent_choice(seed):
    rng = random.Random(seed)
    blocks = [pages.Block("#page", None, 0, ["x"])]
    for i in range(1, 7):
        p = rng.choice(blocks)
        b = pages.Block("div", p, p.depth + 1, ["x"], number=i)
        p.children.append(b)
        blocks.append(b)
    blocks[0].number = 0
    for b in blocks:
        if rng.random() < 0.7 or not b.children:
            b.runs.append((b.number, "t", 0))
    score = np.array([rng.uniform(-2, 2) for _ in blocks])
    own = [score[b.number] * (1.0 if b.runs else 0.25) for b in blocks]
    best = (-1e9, None)
    for state in itertools.product((0, 1, 2), repeat=len(blocks)):
        fine, value = True, 0.0
        for b in blocks:
            s, up = state[b.number], state[b.parent.number] if b.parent else 2
            fine &= (up == 2 or s == up) and (s != 2 or bool(b.children))
            value += own[b.number] if s == 0 else -own[b.number] if s == 1 else (abs(own[b.number]) if b.runs else 0.0) - pages.PRICE
        if fine and value > best[0] + 1e-12:
            best = (value, [s == 0 or (s == 2 and score[i] > 0) for i, s in enumerate(state)])
    got = pages.decode(blocks, score)
    assert [bool(got[b.number]) for b in blocks if b.runs] == [best[1][b.number] for b in blocks if b.runs]


def test_edge_rows(spark, model):
    rows = [(1, "u", None), (2, "u", ""), (3, "u", "   "), (4, "u", "<article><p>" + "w " * 200_000 + "</p></article>"), (None, None, "no tags"), (4, "u", "<"), (5, "u", "<a href='x")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = pages.extract(frame, model).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert [r.text for r in got if r.page_id in (1, 2, 3)] == ["", "", ""]
    assert max(r.n_chars for r in got) == 399_999
    assert pages.extract(frame.limit(0), pages.fit(frame.limit(0))).count() == 0


@pytest.mark.parametrize("page, blocks, text", [
    ("<div>" + "<p>some text, here.</p>" * 100_000 + "</div>", 100_002, " ".join(["some text, here."] * 100_000)),
    ("<div>" * 100_000 + "x<p>y", 100_002, "x y"),
    ("<div>" * 100_000 + "</p></li>" * 100_000, 100_001, ""),
    ("<a " * 100_000, 1, ("<a " * 100_000).strip()),
    ("<a '" * 100_001 + ">", 1, "<a '"),
    ("<!" * 100_000, 1, "<!" * 100_000),
], ids=["siblings", "levels", "ends of nothing", "open tags", "open quotes", "open declarations"])
def test_large_and_broken_pages_take_time_by_their_length(page, blocks, text, model):
    began = time.process_time()
    made = pages.tree(page)
    scores = model.boosted.score(pages.features(made, model.odds))
    assert len(pages.decode(made, scores)) == len(made) == blocks
    assert time.process_time() - began < 30  # a minute and far more where each tag looks at all others
    assert " ".join(r[1] for r in sorted(r for b in made for r in b.runs)) == text


def test_sums_over_siblings(real, model):
    for page in real[:20]:
        blocks = pages.tree(page)
        got = pages.features(blocks, model.odds)
        chars = [0] * len(blocks)
        for b in reversed(blocks):
            chars[b.number] += sum(len(r[1]) for r in b.runs)
            if b.parent is not None:
                chars[b.parent.number] += chars[b.number]
        for b in blocks:
            brothers = b.parent.children if b.parent is not None else [b]
            family = sum(chars[x.number] for x in brothers)
            assert got[b.number, 14] == len(brothers)
            assert got[b.number, 15] == sum(x.tag == b.tag for x in brothers) / len(brothers)
            assert got[b.number, 16] == (chars[b.number] / family if family else 0)


def test_the_sample_is_of_different_pages(spark, monkeypatch):
    rows = [("<p>hot</p>",)] * 500 + [(f"<p>{k}</p>",) for k in range(9)] + [(None,)]
    seen = []
    monkeypatch.setattr(pages, "train", seen.append)
    pages.fit(spark.createDataFrame(rows, "html string"), sample=10)
    assert sorted(seen[0]) == sorted({r[0] for r in rows if r[0]})
    pages.fit(spark.createDataFrame([], "html string"))
    assert seen[1] == []
