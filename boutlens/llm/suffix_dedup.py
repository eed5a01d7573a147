"""Substring dedup with sparse suffix arrays.

Of all suffixes only those at content-selected places are kept: the minimisers (anchors) of the windows.  In each shard the
kept suffixes of one anchor are sorted by their words; neighbours are compared once, which gives the words each
shares with the next to the right, and the same is done for the words to the left.  A match of ``window`` words that
starts ``o`` words left of the anchor is then a pair of runs: equal for ``window - o`` words to the right and ``o`` to the left.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from boutlens.llm import repeats, words


def sort_side(groups: np.ndarray, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by group and then by columns, and how many columns each shares with the row before it.

    Sharing is -1 at the first row of a group.  Zeros are the end of a text and equal nothing.
    """
    order = np.lexsort([*matrix.T[::-1], groups])
    m, g = matrix[order], groups[order]
    same = (m[1:] == m[:-1]) & (m[1:] > 0)
    lcp = np.where(same.all(axis=1), m.shape[1], same.argmin(axis=1)) if m.shape[1] else np.zeros(len(m) - 1, int)
    return order, np.concatenate(([-1], np.where(g[1:] == g[:-1], lcp, -1)))


def runs_of(order: np.ndarray, lcp: np.ndarray, least: int) -> np.ndarray:
    """A number for each row; equal where rows share at least so many columns."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(lcp < least)
    return out


def match(runs: list[np.ndarray], owners: np.ndarray, anchors: np.ndarray, window: int, gram: int = 16) -> list[np.ndarray]:
    """Repeated windows of each piece of a shard."""
    if not runs:
        return []
    numbers = np.unique(np.concatenate(runs), return_inverse=True)[1] + 1
    width = window - gram
    n = len(runs)
    left, right = np.zeros((n, width), np.int64), np.zeros((n, window), np.int64)
    place, size = np.empty(n, np.int64), np.array([len(r) for r in runs])
    at = 0
    for i, r in enumerate(runs):
        grams = words.Sequence(r).grams(gram)
        p = place[i] = int(np.flatnonzero(words.signed(grams) == anchors[i])[0])
        own = numbers[at : at + len(r)]
        at += len(r)
        before, after = own[max(0, p - width) : p][::-1], own[p : p + window]
        left[i, : len(before)], right[i, : len(after)] = before, after
    groups = np.unique(anchors, return_inverse=True)[1]
    sorted_right, sorted_left = sort_side(groups, right), sort_side(groups, left)
    found: list[list[int]] = [[] for _ in runs]
    for o in range(width + 1):
        there = (place >= o) & (place - o + window <= size)
        r, s = runs_of(*sorted_right, window - o), runs_of(*sorted_left, o)
        rows = np.flatnonzero(there)
        if len(rows) < 2:
            continue
        key = np.unique(r[rows] * np.int64(n + 1) + s[rows], return_inverse=True)[1]
        least = np.full(key.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, key, owners[rows])
        for i in rows[least[key] < owners[rows]]:
            found[i].append(int(place[i] - o))
    return [np.array(sorted(x), np.int64) for x in found]


def spans(docs: DataFrame, window: int = 50, text: str = "text") -> DataFrame:
    """(doc_id, tid, start, end): word ranges to remove from documents that repeat earlier ones."""
    return repeats.repeated_spans(docs, match, window, text=text, label="suffixes")


def dedup(docs: DataFrame, window: int = 50, text: str = "text") -> DataFrame:
    """``docs``, all rows and columns, with repeated passages cut out of the texts.  A text may become empty."""
    return repeats.cleaned(repeats.with_spans(docs, spans(docs, window, text), text), text)
