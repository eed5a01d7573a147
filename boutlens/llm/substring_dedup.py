"""Substring dedup with suffix automata.

The reference texts of a shard (the first holders of pieces that share anchors) become one suffix automaton over words.
Each state knows the least doc_id of the places where its strings end.  A document's pieces stream past the
automaton; matching statistics give, at each word, the longest run that the reference holds, cut at the window length, and
a window is a repeat where the state of its length has a smaller doc_id.

A corpus has no proven bound, so its automata are not broadcast whole: each shard, of bounded size, goes only to the task
that holds the pieces with its anchors.  `against` takes a small reference and does broadcast it, shard by shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutlens.llm import repeats, words

NONE = np.iinfo(np.int64).max
#: Words of one broadcast automaton.
SHARD_WORDS = 50_000


class Automaton:
    """Suffix automaton of several word sequences; ``least[s]`` is the smallest owner of a place where state s ends."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.least = [-1], [0], [NONE]

    def _state(self, length: int, link: int, after: dict[int, int], least: int) -> int:
        self.next.append(after)
        self.link.append(link)
        self.length.append(length)
        self.least.append(least)
        return len(self.next) - 1

    def _clone(self, p: int, q: int, word: int) -> int:
        c = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]), NONE)
        self.link[q] = c
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = c
            p = self.link[p]
        return c

    def add(self, sequence: list[int], owner: int) -> None:
        nxt, link, length, least = self.next, self.link, self.length, self.least
        last = 0
        for w in sequence:
            q = nxt[last].get(w)
            if q is not None:  # an earlier sequence went this way
                last = q if length[q] == length[last] + 1 else self._clone(last, q, w)
                least[last] = min(least[last], owner)
                continue
            cur, p = self._state(length[last] + 1, 0, {}, owner), last
            while p >= 0 and w not in nxt[p]:
                nxt[p][w] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][w]
                link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, w)
            last = cur

    def close(self) -> Automaton:
        """Hand the least owners down to the shorter strings."""
        least, link = self.least, self.link
        for s in np.argsort(-np.asarray(self.length), kind="stable").tolist():
            p = link[s]
            if p >= 0 and least[s] < least[p]:
                least[p] = least[s]
        return self

    def matches(self, sequence: list[int], window: int) -> Iterator[tuple[int, int]]:
        """(place, least owner) of each window that the reference holds, by matching statistics cut at the window."""
        nxt, link, length, least = self.next, self.link, self.length, self.least
        s = n = 0
        for i, w in enumerate(sequence):
            while s and w not in nxt[s]:
                s = link[s]
                n = length[s]
            if w in nxt[s]:
                s, n = nxt[s][w], n + 1
            if n >= window:
                n = window
                while length[link[s]] >= window:
                    s = link[s]
                yield i - window + 1, least[s]


def match(runs: list[np.ndarray], owners: np.ndarray, anchors: np.ndarray, window: int) -> list[np.ndarray]:
    """Repeated windows of each piece of a shard."""
    numbers = np.unique(np.concatenate(runs), return_inverse=True)[1].tolist() if runs else []
    parts, at = [], 0
    for r in runs:
        parts.append(numbers[at : at + len(r)])
        at += len(r)
    a = Automaton()
    for p, d in zip(parts, owners.tolist(), strict=True):
        a.add(p, d)
    a.close()
    return [np.array([i for i, least in a.matches(p, window) if least < d], np.int64) for p, d in zip(parts, owners.tolist(), strict=True)]


def spans(docs: DataFrame, window: int = 50, text: str = "text") -> DataFrame:
    """(doc_id, tid, start, end): word ranges to remove from documents that repeat earlier ones."""
    return repeats.repeated_spans(docs, match, window, text=text, label="automata")


def dedup(docs: DataFrame, window: int = 50, text: str = "text") -> DataFrame:
    """``docs``, all rows and columns, with repeated passages cut out of the texts.  A text may become empty."""
    return repeats.cleaned(repeats.with_spans(docs, spans(docs, window, text), text), text)


def against(docs: DataFrame, reference: DataFrame, window: int = 50, text: str = "text", max_words: int = 2_000_000) -> DataFrame:
    """(doc_id, tid, start, end): ranges of ``docs`` that stand in ``reference`` (column ``text``), in windows.

    The reference is counted first and refused above ``max_words``; then each shard's automaton is broadcast and all documents
    stream past it.  Texts of the reference are not split, so a shard ends with the text that fills it.
    """
    size = reference.agg(F.sum(F.length("text"))).first()[0] or 0
    if size > 12 * max_words:
        raise ValueError(f"the reference has {size} characters; the bound is {12 * max_words}")
    spark, out = docs.sparkSession, None
    shard, room = Automaton(), SHARD_WORDS
    shards = []
    for row in reference.where(F.col("text").isNotNull()).select("text").toLocalIterator():
        seq = words.text_hashes(row.text).tolist()
        shard.add(seq, 0)
        room -= len(seq)
        if room <= 0:
            shards.append(shard.close())
            shard, room = Automaton(), SHARD_WORDS
    keyed = docs.where(F.col(text).isNotNull()).select("doc_id", F.hash(text).alias("tid"), F.col(text).alias("text"))
    for s in [*shards, shard.close()]:
        sent = spark.sparkContext.broadcast((s.next, s.link, s.length, s.least))

        def run(frames: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            a = Automaton()
            a.next, a.link, a.length, a.least = sent.value
            for frame in frames:
                for d, t, x in frame.itertuples(index=False, name=None):
                    at = [i for i, _ in a.matches(words.text_hashes(x).tolist(), window)]
                    if at:
                        yield pd.DataFrame({"doc_id": pd.array([d] * len(at), "Int64"), "tid": t, "start": at, "end": [i + window for i in at]})

        part = keyed.mapInPandas(run, "doc_id long, tid int, start int, end int")
        out = part if out is None else out.unionByName(part)
    return out
