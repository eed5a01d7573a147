"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word is embedded as the mean of rows of one hashed table: one for the whole lower-cased word and one for each of its beginnings
of four to six bytes.  Filters of several widths slide over the words; each keeps its largest response in
the whole text, and a logistic layer scores these.  Texts are read in blocks of words that overlap by the widest
filter, so memory doesn't grow with a text.  Many short texts are hashed, embedded and searched at once; products of matrices are
taken text by text, since their last bits depend on their shape, so no score depends on a text's neighbours.

The model is fitted on all labelled rows that may be used for training.  How far each piece leans to a class is counted over all of
them.  They are then hashed into groups of some ``GROUP_ROWS`` rows; each group fits the common start on its own, and the mean of what
the groups changed, by their rows, is added to the start.  Scores depend on the text alone.  Per language, a threshold is
set on all these rows: the one with the best F1, if the language has enough rows of both classes, else ``THRESHOLD``.

Defined cases: null and empty texts get the score of no response at all; without rows of both classes every score is the
share of class 1 (0 without rows); labels of unknown documents are ignored; a document with contradicting labels
counts once for each; repeated rows get equal scores; columns named like the results are replaced.
"""

from __future__ import annotations

import copy
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutlens.llm import words
from boutlens.operators import ranges
from boutlens.session import materialize

GROUP_ROWS = 3000
#: changes of weights are summed as integers of this unit, so that the sum doesn't depend on an order
UNIT = 2.0**-45
ROWS, WIDTH = 1 << 16, 8
WIDTHS, FILTERS = (1, 2, 3), 6
BEGINNINGS = (4, 5, 6)
EPOCHS, BATCH, RATE = 8, 32, 0.02
BLOCK_WORDS = 4096
#: bytes of texts hashed at once
BLOCK_BYTES = 1 << 15
THRESHOLD = 0.7
LEAST_PER_LANGUAGE = 20


def pieces(texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    """For each text the rows of the table for each word: the word and its beginnings (the word again where it is shorter)."""
    some, size = [], 0
    for text in texts:
        some.append((text or "").encode())
        size += len(some[-1]) + 1
        if size >= BLOCK_BYTES:
            yield from _pieces(some)
            some, size = [], 0
    if some:
        yield from _pieces(some)


def _pieces(texts: list[bytes]) -> list[np.ndarray]:
    """`pieces` of some texts, hashed as one; the space between two ends every word."""
    raw = words.LOWER[np.frombuffer(b" ".join(texts), np.uint8)]
    s, e = words.spans(raw, words.PUNCTUATION)
    out = np.empty((len(s), 1 + len(BEGINNINGS)), np.int32)
    for k, h in enumerate(words.hashes_to(raw, s, e, [e, *(np.minimum(e, s + n) for n in BEGINNINGS)])):
        out[:, k] = (words.mix(h + np.uint64(k)) & np.uint64(ROWS - 1)).astype(np.int32)
    return np.split(out, np.searchsorted(s, np.cumsum([len(t) + 1 for t in texts[:-1]])))


@dataclass
class Model:
    table: np.ndarray
    filters: list[np.ndarray]
    shift: np.ndarray
    weight: np.ndarray
    bias: float
    thresholds: dict[str, float]

    @classmethod
    def start(cls, seed: int = 1) -> Model:
        rng = np.random.default_rng(seed)
        table = rng.normal(0, 0.1, (ROWS, WIDTH)).astype(np.float32)
        filters = [rng.normal(0, 1 / np.sqrt(w * WIDTH), (w, WIDTH, FILTERS)).astype(np.float32) for w in WIDTHS]
        n = FILTERS * len(WIDTHS)
        return cls(table, filters, np.zeros(n, np.float32), rng.normal(0, 0.1, n).astype(np.float32), 0.0, {})

    def embed(self, rows: np.ndarray) -> np.ndarray:
        first, *others = rows.T.astype(np.intp)
        x = self.table.take(first, axis=0)
        for k in others:
            x += self.table.take(k, axis=0)
        return x / np.float32(rows.shape[1])

    def respond(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """For the pieces of each text, the largest response of each filter and the word where it begins; 0 and -1 without any above 0."""
        best, where = np.zeros((len(texts), len(self.shift)), np.float32), np.full((len(texts), len(self.shift)), -1)
        run, size = [], 0
        for i, rows in enumerate(texts):
            for at in range(0, len(rows), BLOCK_WORDS):
                run.append((i, at, rows[at : at + BLOCK_WORDS + max(WIDTHS) - 1]))
                size += len(run[-1][2])
                if size >= BLOCK_WORDS:
                    self._respond(run, best, where)
                    run, size = [], 0
        if run:
            self._respond(run, best, where)
        return best, where

    def _respond(self, run: list[tuple[int, int, np.ndarray]], best: np.ndarray, where: np.ndarray) -> None:
        """Raises ``best`` and ``where`` by the responses to blocks: of text i, from word ``at``, these pieces."""
        x = self.embed(np.concatenate([rows for _, _, rows in run]))
        ends = np.cumsum([len(rows) for _, _, rows in run])
        begins = ends - [len(rows) for _, _, rows in run]
        top, value = np.zeros((len(run), len(self.shift)), np.intp), np.empty((len(run), len(self.shift)), np.float32)
        for i, f in enumerate(self.filters):
            z, part = np.empty((len(x), FILTERS), np.float32), slice(i * FILTERS, (i + 1) * FILTERS)
            for t, a, b in zip(top[:, part], begins.tolist(), ends.tolist(), strict=True):
                n = min(b - a - f.shape[0] + 1, BLOCK_WORDS)
                if n < 1:
                    z[a] = -np.inf
                    continue
                own = z[a : a + n]
                np.matmul(x[a : a + n], f[0], out=own)
                for k in range(1, f.shape[0]):
                    own += x[a + k : a + k + n] @ f[k]
                t[:] = own.argmax(axis=0)
            value[:, part] = z[begins[:, None] + top[:, part], np.arange(FILTERS)]
        value += self.shift
        text, at = np.array([i for i, _, _ in run]), np.array([at for _, at, _ in run])
        # the first blocks of all texts at once, then the later ones in their order
        for j in [np.flatnonzero(at == 0), *np.flatnonzero(at)[:, None]]:
            more = value[j] > best[text[j]]
            best[text[j]] = np.where(more, value[j], best[text[j]])
            where[text[j]] = np.where(more, at[j, None] + top[j], where[text[j]])

    def scores(self, texts: Iterable[str | None]) -> list[float]:
        out, some, size = [], [], 0
        for rows in pieces(texts):
            some.append(rows)
            size += len(rows) + 1
            if size >= BLOCK_WORDS:
                out += self._scores(some)
                some, size = [], 0
        return out + self._scores(some)

    def _scores(self, texts: list[np.ndarray]) -> list[float]:
        z = np.array([float(b @ self.weight) for b in self.respond(texts)[0]]) + self.bias
        return (1 / (1 + np.exp(-np.clip(z, -500, 500)))).tolist()

    def score(self, text: str | None) -> float:
        return self.scores([text])[0]


class Adam:
    def __init__(self, *shapes):
        self.m, self.v, self.t = [np.zeros(s, np.float32) for s in shapes], [np.zeros(s, np.float32) for s in shapes], 0

    def step(self, values, grads, rate):
        self.t += 1
        for k, (x, g) in enumerate(zip(values, grads, strict=True)):
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * g * g
            x -= rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)


def count_pieces(texts: Iterable[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Texts of each class that hold each piece."""
    held, last = np.zeros((2, ROWS)), np.empty(ROWS, np.int64)
    for rows, c in zip(texts, y, strict=True):
        piece, at = rows.ravel(), np.arange(rows.size)
        last[piece] = at
        held[int(c), piece[last[piece] == at]] += 1
    return held


def lean(held: np.ndarray, n0: float, n1: float, noise: np.ndarray) -> np.ndarray:
    """The table before fitting: how far each piece leans to class 1, by the test of two shares of texts, beside noise.

    Pieces of no training text start and stay at zero, so words never seen call up nothing.
    """
    p = held.sum(axis=0) / (n0 + n1)
    z = (held[1] / n1 - held[0] / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n0 + 1 / n1))
    out = noise * (p > 0)[:, None]
    out[:, 0] = np.clip(z / 8, -1, 1) * (p > 0)
    return out.astype(np.float32)


def constant(share: float, seed: int = 1) -> Model:
    """The model without rows of both classes: every score is the share of class 1."""
    model = Model.start(seed)
    model.weight[:] = 0
    model.bias = float(np.log(share / (1 - share))) if 0 < share < 1 else (500.0 if share else -500.0)
    return model


def begin(held: np.ndarray, n0: float, n1: float, seed: int = 1) -> Model:
    """The start that all groups share."""
    model = Model.start(seed)
    model.bias = float(np.log(n1 / n0))
    model.table[:] = lean(held, n0, n1, model.table)
    for f in model.filters:
        f[:, 0] = np.abs(f[:, 0]) + 1 / len(f)
    model.weight[:] = 1.0
    return model


def train(texts: list[str | None], labels: list[int], seed: int = 1) -> Model:
    """Fit by mini-batches.  Through max pooling only the winning words of a text get a gradient."""
    y = np.asarray(labels, np.float32)
    n1 = float(y.sum())
    n0 = len(y) - n1
    if not (n0 and n1):
        return constant(n1 / len(y) if len(y) else 0.0, seed)
    rows = list(pieces(texts))
    return descend(begin(count_pieces(rows, y), n0, n1, seed), rows, y, n1 / len(y), seed)


def spread(filters: list[np.ndarray]) -> np.ndarray:
    """Filter, word of its window, dimension; zero beyond a filter's width."""
    out = np.zeros((len(filters), FILTERS, max(WIDTHS), WIDTH), np.float32)
    for k, f in enumerate(filters):
        out[k, :, : len(f)] = f.transpose(2, 0, 1)
    return out.reshape(-1, *out.shape[2:])


def descend(model: Model, rows: list[np.ndarray], y: np.ndarray, share: float, seed: int = 1) -> Model:
    """``model``, fitted on from where it is; ``share`` is that of class 1 among all training rows."""
    rng = np.random.default_rng(seed)
    bias = np.array([model.bias], np.float32)
    params = [*model.filters, model.shift, model.weight, bias]
    adam, squares = Adam(*(p.shape for p in params)), np.full(ROWS, 1e-6, np.float32)
    n, there, place = len(model.shift), np.zeros(ROWS, bool), np.empty(ROWS, np.int64)
    inside = np.arange(max(WIDTHS)) < np.repeat(WIDTHS, FILTERS)[:, None]
    # both classes weigh the same while fitting; the bias is set to the true share afterwards
    heavy = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
    for epoch in range(EPOCHS):
        order = rng.permutation(len(y))
        rate = RATE * (1 - epoch / EPOCHS)
        for b in range(0, len(order), BATCH):
            some = order[b : b + BATCH]
            texts = [rows[i] for i in some]
            best, where = model.respond(texts)
            z = np.array([float(r @ model.weight) for r in best]) + float(bias[0])
            d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[some]) * heavy[some] / BATCH
            pull = np.where(where >= 0, d[:, None] * model.weight, 0)
            # the words of the winning windows: text, filter, place in the window
            used = (where >= 0)[:, :, None] & inside
            text, filt, tap = np.nonzero(used)
            near = np.concatenate(texts)[np.cumsum([0, *map(len, texts[:-1])])[text] + where[text, filt] + tap]
            seen = np.zeros((*used.shape, WIDTH))
            seen[used] = pull[text, filt, None] * model.embed(near)
            # summed text by text, as rounded sums depend on their order
            sums = np.zeros(inside.size * WIDTH + 2 * n + 1, np.float32)
            for part in np.concatenate([seen.reshape(len(texts), -1), pull, d[:, None] * best, d[:, None]], axis=1):
                sums += part
            taps, *others = np.split(sums, inside.size * WIDTH + np.array([0, n, 2 * n]))
            taps = taps.reshape(len(WIDTHS), FILTERS, max(WIDTHS), WIDTH)
            grads = [*[taps[k, :, :w].transpose(1, 2, 0) for k, w in enumerate(WIDTHS)], *others]
            back = pull[text, filt, None] * spread(model.filters)[filt, tap] / near.shape[1]
            adam.step(params, grads, rate)
            if len(near):
                there[near] = True
                at = np.flatnonzero(there)
                there[at] = False
                place[at] = np.arange(len(at))
                g = np.zeros((len(at), WIDTH), np.float32)
                cells = place[near][:, :, None] * WIDTH + np.arange(WIDTH)
                np.add.at(g.reshape(-1), cells.ravel(), np.repeat(back.astype(np.float32)[:, None], near.shape[1], axis=1).ravel())
                squares[at] += (g * g).mean(axis=1)
                model.table[at] -= 4 * rate * g / np.sqrt(squares[at])[:, None]
    model.bias = float(bias[0])
    return model


def thresholds(rated: DataFrame) -> dict[str, float]:
    """Per language of ``rated`` (lang, score, y) the score with the best F1, midway to the next lower one.

    Equal scores are one row, and rows of one language lie in sorted ranges, so no language meets in one task.
    """
    apart = rated.where(F.col("lang").isNotNull()).groupBy("lang", "score").agg(F.count("*").alias("n"), F.sum("y").alias("hits"))
    apart = materialize(apart.withColumn("neg", -F.col("score")), "toxicity-scores")
    total = apart.groupBy("lang").agg(F.sum("n").alias("_n"), F.sum("hits").alias("_y"))
    total = total.where(F.least(F.col("_y"), F.col("_n") - F.col("_y")) >= LEAST_PER_LANGUAGE)
    sums = ranges.running(ranges.in_order(apart, ["lang"], ["neg"], "toxicity-order"), ["lang"], {"_at": ("sum", F.col("n")), "_hits": ("sum", F.col("hits"))})
    f1 = 2 * F.col("_hits") / (F.col("_at") + F.col("_y"))
    best = sums.join(total, "lang").groupBy("lang").agg(F.max(F.struct(f1.alias("f1"), "score")).alias("best")).select("lang", F.col("best.score").alias("top"))
    below = apart.join(best, "lang").groupBy("lang", "top").agg(F.max(F.when(F.col("score") < F.col("top"), F.col("score"))).alias("next"))
    return {r.lang: (r.top + (r.next or 0.0)) / 2 for r in below.collect()}


def in_training() -> Column:
    """Rows whose crc32 of the doc_id, as text, modulo 3 is not 1."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1


def flat(model: Model) -> np.ndarray:
    """All parameters in rows of ``WIDTH`` values: the table, then the others."""
    rest = np.concatenate([*[f.ravel() for f in model.filters], model.shift, model.weight, [model.bias]]).astype(np.float64)
    return np.concatenate([model.table.astype(np.float64), np.resize(np.append(rest, np.zeros(-len(rest) % WIDTH)), (-(-len(rest) // WIDTH), WIDTH))])


def unflat(values: np.ndarray, like: Model) -> Model:
    """The model of `flat` values."""
    rest, parts = values[ROWS:].ravel(), []
    for shape in [*[f.shape for f in like.filters], like.shift.shape, like.weight.shape]:
        n = int(np.prod(shape))
        parts.append(rest[:n].reshape(shape).astype(np.float32))
        rest = rest[n:]
    return Model(values[:ROWS].astype(np.float32), parts[:-2], parts[-2], parts[-1], float(rest[0]), {})


def _counted(batches):
    """(y, piece, n) of a task's rows."""
    held = np.zeros((2, ROWS))
    for batch in batches:
        held += count_pieces(pieces(batch.text), batch.y.to_numpy())
    y, piece = np.nonzero(held)
    yield pd.DataFrame({"y": y.astype(np.int32), "piece": piece.astype(np.int32), "n": held[y, piece].astype(np.int64)})


def fit_rows(rows: DataFrame, group_rows: int = GROUP_ROWS, seed: int = 1) -> Model:
    """A model from all ``rows`` (doc_id, text, lang, y)."""
    totals = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    n0, n1 = totals.get(0, 0), totals.get(1, 0)
    n = n0 + n1
    if not (n0 and n1):
        return constant(n1 / n if n else 0.0, seed)
    held = np.zeros((2, ROWS))
    for r in rows.select("text", "y").mapInPandas(_counted, "y int, piece int, n long").groupBy("y", "piece").agg(F.sum("n").alias("n")).collect():
        held[r.y, r.piece] = r.n
    start = begin(held, n0, n1, seed)
    sent = rows.sparkSession.sparkContext.broadcast(start)
    names = [f"v{k}" for k in range(WIDTH)]

    def change(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "y", "tie", "lang"], ignore_index=True, kind="stable")
        model = copy.deepcopy(sent.value)
        before = flat(model)
        model = descend(model, list(pieces(group.text)), group.y.to_numpy(np.float32), n1 / n, seed)
        moved = flat(model) - before
        at = np.flatnonzero(np.any(moved != 0, axis=1))
        out = pd.DataFrame(np.rint(moved[at] * (len(group) / n) / UNIT).astype(np.int64), columns=names)
        out.insert(0, "at", at.astype(np.int32))
        return out

    tie = F.xxhash64("text")
    groups = rows.withColumn("tie", tie).withColumn("g", F.pmod(F.xxhash64("doc_id", "y", "tie"), F.lit(-(-n // group_rows))))
    moved = groups.groupBy("g").applyInPandas(change, "at int, " + ", ".join(f"{c} long" for c in names))
    # as many rows as the model has, however many groups there are
    total = moved.groupBy("at").agg(*[F.sum(c).alias(c) for c in names]).toPandas()
    values = flat(start)
    values[total["at"].to_numpy()] += total[names].to_numpy(np.float64) * UNIT
    return unflat(values, start)


def training_rows(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """Labelled rows that may be used for training (doc_id, text, lang, y).

    Labels grow with the corpus, so they are merged at any size and never broadcast: the work of a small run tells that of a large one.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & in_training()).select("doc_id", F.col("toxic").cast("int").alias("y")).distinct()
    return docs.where(in_training()).select("doc_id", F.col(text).alias("text"), "lang").join(known.hint("merge"), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, text: str = "text") -> Model:
    """A model from all labelled rows that may be used for training, with the thresholds of their languages."""
    rows = materialize(training_rows(docs, labels, text), "toxicity-rows")
    model = fit_rows(rows)
    model.thresholds = thresholds(score(rows, model).select("lang", "score", "y"))
    return model


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with score, threshold (of its language) and toxic."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(sent.value.scores(texts), dtype=float)

    rows = docs.withColumn("score", of(F.coalesce(F.col(text), F.lit(""))))
    by = F.create_map(*[F.lit(x) for pair in sorted(model.thresholds.items()) for x in pair]) if model.thresholds else F.lit(None).cast("map<string,double>")
    rows = rows.withColumn("threshold", F.coalesce(F.try_element_at(by, F.col("lang")), F.lit(THRESHOLD)))
    return rows.withColumn("toxic", F.col("score") >= F.col("threshold"))
