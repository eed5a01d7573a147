"""Token counts by byte-pair merging, without making tokens.

A text is cut into pieces as the tokenizer's rules say; the count of a piece is its bytes minus the merges that a heap of
adjacent pairs, popped by rank over a linked list of symbols, performs.  Each task keeps the counts of pieces it has
seen in a table of bounded size.  A null text counts as empty.
"""

from __future__ import annotations

import heapq
import json

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: split rule of byte-level BPE (fixed value)
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MEMO = 500_000


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in kept}
    spare = (b for b in range(256) if b not in out)
    out |= {b: chr(256 + i) for i, b in enumerate(spare)}
    return [out[b] for b in range(256)]


class Counter:
    """Counts for one tokenizer file.  Read once per Python worker."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.letters = byte_letters()
        self.special = [t["content"] for t in spec.get("added_tokens", []) if t.get("special")]
        self.split_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pieces = regex.compile(PIECES)
        self.seen: dict[str, int] = {}

    def merged(self, piece: str) -> int:
        """Symbols left of one piece: the lowest rank first, the leftmost of equal ranks."""
        letters = [self.letters[b] for b in piece.encode()]
        left = n = len(letters)
        if n < 2:
            return n
        rank = self.rank
        heap = [(r, i) for i in range(n - 1) if (r := rank.get((letters[i], letters[i + 1]))) is not None]
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            r, i = heapq.heappop(heap)
            a = letters[i]
            if a is None or (j := after[i]) >= n or rank.get((a, letters[j])) != r:
                continue
            letters[i], letters[j] = a + letters[j], None
            k = after[i] = after[j]
            left -= 1
            if k < n:
                before[k] = i
                if (s := rank.get((letters[i], letters[k]))) is not None:
                    heapq.heappush(heap, (s, i))
            if (h := before[i]) >= 0 and (s := rank.get((letters[h], letters[i]))) is not None:
                heapq.heappush(heap, (s, h))
        return left

    def plain(self, text: str) -> int:
        seen, total = self.seen, 0
        for m in self.pieces.finditer(text):
            p = m.group()
            n = seen.get(p)
            if n is None:
                if len(seen) >= MEMO:
                    seen.clear()
                n = seen[p] = self.merged(p)
            total += n
        return total

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.split_special is None:
            return self.plain(text)
        total, at = 0, 0
        for m in self.split_special.finditer(text):
            total += self.plain(text[at : m.start()]) + 1
            at = m.end()
        return total + self.plain(text[at:] if at else text)


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_count(text: Column, name: str) -> Column:
    """Tokens of each whole text by the vocabulary file ``name``, which every worker opens where it is installed."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        c = counter(vocabulary(name))
        return pd.Series([c.count(t) for t in texts], dtype="int64")

    return count(F.coalesce(text, F.lit("")))


def count_tokens(docs: DataFrame, name: str = "byte_bpe_50k.json", limit: int = 1024, text: str = "text") -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit."""
    rows = docs.withColumn("n_bytes", F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long"))
    rows = rows.withColumn("n_tokens", token_count(F.col(text), name))
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
