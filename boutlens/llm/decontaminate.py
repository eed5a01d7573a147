"""Benchmark decontamination with a BM25 index of the test items.

The index holds test items; every passage of every training document is a query.  An item is an entry, or several where it
is longer than ``ENTRY_WORDS``.  Weights are BM25 with statistics over all entries, divided by the score at which an entry counts
as found (``share`` of its own score), so that an entry is found at a sum of 1.  Passages overlap by half and are longer
than two entries, so each leaked entry lies whole in one of them.

Entries are numbered by their own score and cut into blocks of neighbours, so that short and long ones don't share a block.
``top`` has the largest weight of each term in each block: a passage whose terms don't reach 1 in any block holds no
entry.  The others go through block-max WAND, which returns all entries at 1 or more.
Found entries are verified: of the question (all but the last sentence or line) and of the answer (the last), a
share of the three-word runs must stand in the passage.

The index is sent in shards of ``SHARD_WORDS`` words at most, one after the other; there is no bound on the benchmark.

Defined cases: null and empty texts and items give nothing; equal items are found each; a null doc_id is kept as
null in the pairs; repeated rows give repeated pairs; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutlens.llm import words

K1, B = 1.2, 0.75
ENTRY_WORDS, PASSAGE_WORDS = 64, 160
#: neighbouring entries that share a bound for passages, and postings that share one inside a list
BLOCK_ENTRIES, BLOCK_POSTINGS = 2, 16
SHARD_WORDS = 25_000
#: share of an entry's own score, and of the runs of question and answer, that a passage must hold
SHARE, QUESTION, ANSWER = 0.6, 0.6, 0.5
RUN = 3


def terms(text: str | None) -> np.ndarray:
    """Hashes of the lower-cased words without punctuation."""
    raw = words.LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    return words.hashes(raw, *words.spans(raw, words.PUNCTUATION))


def parts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Terms of the question and of the answer: the last line, or the last sentence of one line, is the answer."""
    t = text.strip()
    at = t.rfind("\n")
    if at < 0:
        at = max(t[:-1].rfind(c) for c in ".?!")
    h, cut = terms(t), len(terms(t[: at + 1]))
    if not 0 < cut < len(h):
        cut = (3 * len(h) + 3) // 4
    return h[:cut], h[cut:]


def entries(text: str | None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Question and answer terms of each entry of an item.  A long item has several entries, each cut likewise."""
    if not text or not text.strip():
        return []
    q, a = parts(text)
    h = np.concatenate([q, a])
    if len(h) <= ENTRY_WORDS:
        return [(q, a)] if len(h) else []
    count = -(-len(h) // ENTRY_WORDS)
    edges = np.linspace(0, len(h), count + 1).astype(int)
    pieces = [h[s:e] for s, e in zip(edges[:-1], edges[1:], strict=True)]
    return [(p[: (3 * len(p) + 3) // 4], p[(3 * len(p) + 3) // 4 :]) for p in pieces]


def runs(h: np.ndarray) -> np.ndarray:
    k = min(RUN, len(h))
    return np.unique(words.Sequence(h).grams(k)) if k else np.empty(0, np.uint64)


@dataclass
class Index:
    """One shard.  Postings of term i are ``entry[at[i]:at[i+1]]`` with ``weight``; ``top`` is terms by blocks."""

    items: list[int]
    questions: list[np.ndarray]
    answers: list[np.ndarray]
    vocabulary: np.ndarray
    at: np.ndarray
    entry: np.ndarray
    weight: np.ndarray
    most: np.ndarray
    top: np.ndarray

    @classmethod
    def of(cls, items: list[tuple[int, str]], df: dict[int, int], total: int, mean: float, share: float = SHARE) -> Index:
        rows = []
        for item, text in items:
            for q, a in entries(text):
                h = np.concatenate([q, a])
                t, tf = np.unique(h, return_counts=True)
                n = np.array([df[x] for x in t.tolist()], float)
                w = np.log1p((total - n + 0.5) / (n + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(h) / mean))
                rows.append((float(w.sum()), item, q, a, t, w / (share * w.sum())))
        rows.sort(key=lambda r: r[0])
        t = np.concatenate([np.empty(0, np.uint64), *(r[4] for r in rows)])
        w = np.concatenate([np.empty(0), *(r[5] for r in rows)])
        e = np.repeat(np.arange(len(rows)), [len(r[4]) for r in rows])
        order = np.lexsort((e, t))
        t, w, e = t[order], w[order], e[order]
        vocabulary, at = np.unique(t, return_index=True)
        most = np.maximum.reduceat(w, at) if len(t) else w
        top = np.zeros((len(vocabulary), -(-len(rows) // BLOCK_ENTRIES)), np.float32)
        np.maximum.at(top, (np.searchsorted(vocabulary, t), e // BLOCK_ENTRIES), w.astype(np.float32))
        return cls([r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows], vocabulary, np.append(at, len(t)), e, w, most, top)

    def blocks(self, term: int) -> tuple[list[int], list[float], list[int], list[float]]:
        """A posting list with the last entry and the largest weight of each block."""
        e, w = self.entry[self.at[term] : self.at[term + 1]], self.weight[self.at[term] : self.at[term + 1]]
        starts = np.arange(0, len(e), BLOCK_POSTINGS)
        return e.tolist(), w.tolist(), e[np.minimum(starts + BLOCK_POSTINGS, len(e)) - 1].tolist(), np.maximum.reduceat(w, starts).tolist()

    def wand(self, query: np.ndarray, goal: float = 1.0 - 1e-9) -> list[tuple[int, float]]:
        """All (entry, score) at ``goal`` or more for a set of terms, by block-max WAND."""
        lists = [(*self.blocks(t), self.most[t]) for t in query.tolist()]
        at = [0] * len(lists)
        live = [i for i, x in enumerate(lists) if x[0]]
        out = []
        while live:
            live.sort(key=lambda i: lists[i][0][at[i]])
            bound, pivot = 0.0, None
            for k, i in enumerate(live):
                bound += lists[i][4]
                if bound >= goal:
                    pivot = k
                    break
            if pivot is None:
                break
            entry = lists[live[pivot]][0][at[live[pivot]]]
            while pivot + 1 < len(live) and lists[live[pivot + 1]][0][at[live[pivot + 1]]] == entry:
                pivot += 1
            # the block of each list that could hold the pivot entry
            bound, ends = 0.0, []
            for i in live[: pivot + 1]:
                last, top = lists[i][2], lists[i][3]
                b = at[i] // BLOCK_POSTINGS
                while b < len(last) and last[b] < entry:
                    b += 1
                if b < len(last):
                    bound += top[b]
                    ends.append(last[b])
            if bound >= goal:
                target = entry
                if lists[live[0]][0][at[live[0]]] == entry:
                    score = sum(lists[i][1][at[i]] for i in live[: pivot + 1])
                    if score >= goal:
                        out.append((entry, score))
                    target = entry + 1
            else:  # no entry up to the nearest block end, or before the next list begins, can reach the goal
                target = min(ends, default=entry) + 1
                if pivot + 1 < len(live):
                    target = min(target, lists[live[pivot + 1]][0][at[live[pivot + 1]]])
                target = max(target, entry + 1)
            for i in live[: pivot + 1]:
                e = lists[i][0]
                k = at[i]
                while k < len(e) and e[k] < target:
                    k += 1
                at[i] = k
            live = [i for i in live if at[i] < len(lists[i][0])]
        return out

    def search(self, text: str | None) -> dict[int, tuple[float, float, float]]:
        """Verified items of one text: (share of the own score, question overlap, answer overlap), the best of each."""
        h = terms(text)
        if not len(h) or not len(self.vocabulary):
            return {}
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        known = np.flatnonzero(self.vocabulary[at] == h)
        half = PASSAGE_WORDS // 2
        # each place lies in the passages that start in its own half and in the one before
        own = known // half
        key = np.concatenate([own, own[own > 0] - 1]) * len(self.vocabulary) + np.concatenate([at[known], at[known][own > 0]])
        key = np.unique(key)
        passage, term = key // len(self.vocabulary), key % len(self.vocabulary)
        if not len(key):
            return {}
        first = np.flatnonzero(np.concatenate(([True], passage[1:] != passage[:-1])))
        reach = np.add.reduceat(self.top[term], first, axis=0).max(axis=1)
        found: dict[int, tuple[float, float, float]] = {}
        for i in np.flatnonzero(reach >= 1.0 - 1e-4).tolist():
            p = int(passage[first[i]])
            hits = self.wand(term[first[i] : first[i + 1] if i + 1 < len(first) else len(term)])
            if not hits:
                continue
            have = words.Sequence(h[p * half : p * half + PASSAGE_WORDS])
            grams = {k: np.unique(have.grams(k)) for k in range(1, RUN + 1)}
            for e, score in hits:
                share = []
                for part in (self.questions[e], self.answers[e]):
                    want = runs(part)
                    share.append(float(np.isin(want, grams[min(RUN, len(part))]).mean()) if len(want) else 1.0)
                if share[0] >= QUESTION and share[1] >= ANSWER:
                    item = self.items[e]
                    found[item] = max(found.get(item, (0.0, 0.0, 0.0)), (score, *share))
        return found


def indexes(benchmark: DataFrame, share: float = SHARE) -> Iterator[Index]:
    """The index in shards of bounded size.  Statistics of terms are counted by Spark over all entries."""
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for text in frame.text:
                for q, a in entries(text):
                    t = np.unique(h := np.concatenate([q, a]))
                    yield pd.DataFrame({"term": words.signed(t), "words": np.where(np.arange(len(t)) == 0, len(h), 0), "entries": (np.arange(len(t)) == 0).astype(int)})

    counted = items.mapInPandas(count, "term long, words long, entries long")
    total, size = counted.agg(F.sum("entries"), F.sum("words")).first()
    if not total:
        return
    # shards by size: their number follows from the words counted, and items are dealt to them by hash
    shards = -(-size // SHARD_WORDS)
    dealt = items.withColumn("shard", F.pmod(F.xxhash64("item_id"), F.lit(shards)))
    for s in range(shards):
        part = dealt.where(F.col("shard") == s).select("item_id", "text")
        own = part.mapInPandas(count, "term long, words long, entries long").select("term").distinct()
        df = {r.term % (1 << 64): r.n for r in counted.groupBy("term").agg(F.count("*").alias("n")).join(own, "term").toLocalIterator()}
        yield Index.of(sorted((r.item_id, r.text) for r in part.toLocalIterator()), df, total, size / total, share)


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap): every verified pair."""
    out = None
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    for index in indexes(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(frames: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            index = sent.value
            for frame in frames:
                rows = [(d, item, *v) for d, t in zip(frame.doc_id, frame.text, strict=True) for item, v in index.search(t).items()]
                if rows:
                    yield pd.DataFrame(rows, columns=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"]).astype({"doc_id": "Int64"})

        part = docs.select("doc_id", F.col(text).alias("text")).mapInPandas(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item.  Each row is judged where it lies; nothing is shuffled."""

    def holds(sent) -> Column:
        @F.pandas_udf("boolean")
        def found(texts: pd.Series) -> pd.Series:
            return pd.Series([bool(sent.value.search(t)) for t in texts], dtype=bool)
        return found(F.coalesce(F.col(text), F.lit("")))

    for index in indexes(benchmark):
        docs = docs.where(~holds(docs.sparkSession.sparkContext.broadcast(index)))
    return docs
