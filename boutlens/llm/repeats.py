"""Passages that repeat across documents: candidates by content-selected anchors, exact matching per anchor.

A window is ``window`` consecutive words of one document.  A window is a repeat if its word sequence also starts in a
document with a smaller doc_id.  Each window is assigned to the leftmost smallest hash among its ``gram``-word runs, its
anchor; neighbouring windows with one anchor form a piece.  Equal windows have equal anchors, so:

1. anchors of a single document are set aside by one partial aggregate;
2. pieces with equal words are settled by their first document, with no comparison of members: copies and common
   passages cost one row per copy and never meet in one group;
3. what is left are the first holders of pieces that share an anchor and differ.  Their words go to shards of bounded
   size by anchor, where a matcher (suffix automata or sorted suffixes) finds the repeats;
4. anchors with more distinct pieces than a shard may hold are split further, into one row per window: equal windows
   are settled by the least doc_id of each.

Everything is exact but for equal 64-bit hashes of different words or, jointly, equal pairs of 64-bit hashes of pieces.

Defined cases: a null text has no words; a null doc_id is never first and loses nothing; rows with one doc_id don't take
from one another; rows are told apart by (doc_id, text), so repeated rows all get the same result; texts
below ``window`` words are returned whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutlens.llm import words
from boutlens.session import materialize

#: Pieces a shard holds on average, and the most distinct pieces of one anchor that are matched in one shard.
SHARD_PIECES, ANCHOR_PIECES = 1500, 400

#: (words of each piece, first document of each) -> offsets of the repeated windows of each piece
Matcher = Callable[[list[np.ndarray], np.ndarray, np.ndarray, int], list[np.ndarray]]


def cut(h: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of one text: first window, windows, anchor's place and anchor."""
    n = len(h) - window + 1
    if n < 1:
        z = np.empty(0, np.int64)
        return z, z, z, z.view(np.uint64)
    grams = words.Sequence(h).grams(gram)
    width = window - gram + 1
    at = np.lib.stride_tricks.sliding_window_view(grams, width).argmin(axis=1) + np.arange(n)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return first, np.diff(np.append(first, n)), at[first], grams[at[first]]


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    return docs.where(F.col("doc_id").isNotNull() & F.col(text).isNotNull()).select("doc_id", F.hash(text).alias("tid"), F.col(text).alias("text"))


def pieces(docs: DataFrame, window: int, gram: int, text: str = "text") -> DataFrame:
    """(doc_id, tid, anchor, body, pos, n): a row per piece of every document."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sizes, out = [], []
            for x in frame.text:
                h = words.text_hashes(x)
                first, n, place, anchor = cut(h, window, gram)
                sizes.append(len(first))
                if len(first):
                    body = words.Sequence(h, words.BYTE_BASE).of(first, first + n + window - 1) ^ words.mix((place - first).astype(np.uint64))
                    out.append((anchor, body, first, n))
            if out:
                anchor, body, first, n = (np.concatenate(c) for c in zip(*out, strict=True))
                yield pd.DataFrame({"doc_id": np.repeat(frame.doc_id.to_numpy(), sizes), "tid": np.repeat(frame.tid.to_numpy(np.int32), sizes), "anchor": words.signed(anchor),
                                    "body": words.signed(body), "pos": first.astype(np.int32), "n": n.astype(np.int32)})

    return _keyed(docs, text).mapInPandas(run, "doc_id long, tid int, anchor long, body long, pos int, n int")


def _words_of(docs: DataFrame, wanted: DataFrame, window: int, text: str) -> DataFrame:
    """Words of the wanted pieces: the texts of their documents are joined once per document."""
    per = wanted.groupBy("doc_id", "tid").agg(F.collect_list(F.struct("anchor", "body", "pos", "n", "hot")).alias("w"))
    rows = per.join(_keyed(docs, text).dropDuplicates(["doc_id", "tid"]), ["doc_id", "tid"]).select("doc_id", "text", "w.anchor", "w.body", "w.pos", "w.n", "w.hot")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for d, x, anchor, body, pos, n, hot in frame.itertuples(index=False, name=None):
                h = words.text_hashes(x)
                yield pd.DataFrame({"doc_id": d, "anchor": anchor, "body": body, "hot": hot, "words": [h[p : p + k + window - 1].tobytes() for p, k in zip(pos, n, strict=True)]})

    return rows.mapInPandas(run, "doc_id long, anchor long, body long, hot boolean, words binary")


def _windows(found: DataFrame, window: int) -> DataFrame:
    """A row per window of the pieces of anchors that one shard can't hold."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for d, a, b, w in frame.itertuples(index=False, name=None):
                h = np.frombuffer(w, np.uint64)
                off = np.arange(len(h) - window + 1)
                one, two = (words.signed(words.Sequence(h, base).of(off, off + window)) for base in (words.WORD_BASE, words.BYTE_BASE))
                yield pd.DataFrame({"doc_id": d, "anchor": a, "body": b, "one": one, "two": two, "off": off.astype(np.int32)})

    return found.select("doc_id", "anchor", "body", "words").mapInPandas(run, "doc_id long, anchor long, body long, one long, two long, off int")


def repeated_spans(docs: DataFrame, match: Matcher, window: int = 50, gram: int = 16, text: str = "text", label: str = "repeats") -> DataFrame:
    """(doc_id, tid, start, end): word ranges of every repeated window; ``tid`` is the hash of the text.

    Ranges may overlap.  Intermediate tables are written to the shared folder, so a lost executor costs its own tasks.
    """
    every = materialize(pieces(docs, window, gram, text), f"{label}-pieces")
    shared = materialize(every.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).where("a < z").select("anchor"), f"{label}-anchors")
    near = materialize(every.join(shared, "anchor"), f"{label}-shared")
    first = near.groupBy("anchor", "body").agg(F.min(F.struct("doc_id", "tid", "pos", "n")).alias("f")).select("anchor", "body", "f.*")
    first = materialize(first, f"{label}-first")
    owner = first.select("anchor", "body", F.col("doc_id").alias("owner"))
    held = materialize(near.join(owner, ["anchor", "body"]).where("doc_id >= owner"), f"{label}-held")
    copies = held.where("doc_id > owner").select("doc_id", "tid", F.col("pos").alias("start"), (F.col("pos") + F.col("n") + (window - 1)).alias("end"))

    many = first.groupBy("anchor").agg(F.count("*").alias("bodies")).where("bodies > 1").select("anchor", (F.col("bodies") > ANCHOR_PIECES).alias("hot"))
    found = materialize(_words_of(docs, first.join(many, "anchor"), window, text), f"{label}-words")
    shards = max(1, found.where("not hot").count() // SHARD_PIECES)

    def in_shard(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["anchor", "doc_id"])
        runs = [np.frombuffer(w, np.uint64) for w in frame.words]
        hits = match(runs, frame.doc_id.to_numpy(), frame.anchor.to_numpy(), window)
        sizes = [len(x) for x in hits]
        return pd.DataFrame({"anchor": np.repeat(frame.anchor.to_numpy(), sizes), "body": np.repeat(frame.body.to_numpy(), sizes),
                             "owner": np.repeat(frame.doc_id.to_numpy(), sizes), "off": np.concatenate([*hits, np.empty(0, np.int64)]).astype(np.int32)})

    cold = found.where("not hot").withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards))).groupBy("shard").applyInPandas(
        lambda frame: in_shard(frame), "anchor long, body long, owner long, off int")
    wide = materialize(_windows(found.where("hot"), window), f"{label}-windows")
    least = materialize(wide.groupBy("one", "two").agg(F.min("doc_id").alias("least")), f"{label}-least")
    hot = wide.join(least, ["one", "two"]).where("least < doc_id").select("anchor", "body", F.col("doc_id").alias("owner"), "off")
    hits = materialize(cold.unionByName(hot), f"{label}-hits")
    # offsets of one piece become ranges before they meet the places of the piece
    hits = hits.groupBy("anchor", "body", "owner").agg(F.collect_list("off").alias("offs"))
    own = held.where("doc_id = owner").join(hits, ["anchor", "body", "owner"]).select("doc_id", "tid", F.explode("offs").alias("off"), "pos")
    own = own.select("doc_id", "tid", (F.col("pos") + F.col("off")).alias("start"), (F.col("pos") + F.col("off") + window).alias("end"))
    return copies.unionByName(own)


def mark(n: int, starts, ends) -> np.ndarray:
    """Which of n words are covered."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, np.asarray(starts, np.int64), 1)
    np.add.at(edge, np.asarray(ends, np.int64), -1)
    return np.cumsum(edge[:n]) > 0


def with_spans(docs: DataFrame, spans: DataFrame, text: str = "text") -> DataFrame:
    """Every row of ``docs`` with the ranges of its text: ``_start``, ``_end`` (null where none)."""
    per = spans.groupBy("doc_id", "tid").agg(F.collect_list("start").alias("_start"), F.collect_list("end").alias("_end"))
    keyed = docs.withColumn("_tid", F.hash(text))
    per = per.withColumnsRenamed({"doc_id": "_d", "tid": "_t"})
    return keyed.join(per, (keyed.doc_id == per._d) & (keyed._tid == per._t), "left").drop("_d", "_t", "_tid")


def digest(rows: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and n_spans (maximal removed ranges) of rows with ranges."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for d, t, s, e in frame.itertuples(index=False, name=None):
                ws = (t or "").encode().split()
                gone, n, spans = None, 0, 0
                if s is not None and len(s):
                    gone = mark(len(ws), s, e)
                    n, spans = int(gone.sum()), int((np.diff(np.concatenate(([False], gone)).astype(np.int8)) == 1).sum())
                    ws = [w for w, g in zip(ws, gone.tolist(), strict=True) if not g]
                out.append((d, len(ws) + n, n, hashlib.sha256(b" ".join(ws)).hexdigest(), spans))
            yield pd.DataFrame({k: pd.Series([r[i] for r in out], dtype=kind) for i, (k, kind) in enumerate((("doc_id", "Int64"), ("n_words", "int64"), ("n_removed", "int64"), ("kept_sha256", object), ("n_spans", "int64")))})

    return rows.select("doc_id", F.col(text).alias("text"), "_start", "_end").mapInPandas(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, n_spans long")


def cleaned(rows: DataFrame, text: str = "text") -> DataFrame:
    """The rows with the covered words and the gaps inside covered ranges cut out of the text; all else stays as it is."""

    @F.pandas_udf("string")
    def cut_out(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        out = []
        for t, s, e in zip(texts, starts, ends, strict=True):
            raw = np.frombuffer(t.encode(), np.uint8)
            first, last = words.spans(raw)
            gone = np.concatenate(([False], mark(len(first), s, e), [False])).astype(np.int8)
            edge = np.diff(gone)
            keep, at = [], 0
            for a, z in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
                keep.append(raw[at : first[a]].tobytes())
                at = first[z] if z < len(first) else last[-1]
            keep.append(raw[at:].tobytes())
            out.append(b"".join(keep).decode())
        return pd.Series(out, dtype=object)

    touched = F.col("_start").isNotNull()
    new = F.when(touched, cut_out(F.when(touched, F.col(text)).otherwise(""), F.coalesce("_start", F.array().cast("array<int>")), F.coalesce("_end", F.array().cast("array<int>")))).otherwise(F.col(text))
    return rows.withColumn(text, new).drop("_start", "_end")
