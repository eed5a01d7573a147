"""Words of texts as 64-bit numbers, found and hashed with numpy.

A word is a run of bytes that are neither a space nor one of ``\\x09-\\x0D``; ``bytes.split`` cuts at
exactly these.  Hashes are taken over the UTF-8 bytes, in blocks, so that memory stays at
a few bytes per byte of one text.
"""

from __future__ import annotations

import numpy as np

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: everything but ASCII letters, digits and the bytes of other letters
PUNCTUATION = np.ones(256, bool)
PUNCTUATION[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
BLOCK = 1 << 17
_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i in 0..n."""
    have = _TABLES.get(base)
    if have is None or len(have[0]) <= n:
        size = max(BLOCK, 2 * n) + 1
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            out.append(np.multiply.accumulate(steps))
        have = _TABLES[base] = (out[0], out[1])
    return have


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def spans(raw: np.ndarray, cut: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of each word."""
    gap = np.ones(len(raw) + 2, bool)
    gap[1:-1] = cut[raw]
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    return edges[::2], edges[1::2]


def hashes_to(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, cuts: list[np.ndarray]) -> list[np.ndarray]:
    """64-bit hashes of the ranges from ``starts`` to each of ``cuts``, which lie inside the words.

    Equal bytes give equal hashes wherever they stand.  Words are in order of their starts; blocks grow where one
    word is longer than a block.
    """
    out = [np.empty(len(starts), np.uint64) for _ in cuts]
    at = 0
    while at < len(starts):
        first = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, first + BLOCK, "right")))
        part = raw[first : ends[to - 1]]
        up, down = powers(BYTE_BASE, len(part))
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=total[1:])
        s = starts[at:to] - first
        below, scale = total[s], down[s]
        for o, cut in zip(out, cuts, strict=True):
            e = cut[at:to] - first
            o[at:to] = (total[e] - below) * scale + (e - s).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)
        at = to
    return [mix(o) for o in out]


def hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of whole words."""
    return hashes_to(raw, starts, ends, [ends])[0]


def text_hashes(text: str | bytes | None, lower: bool = False) -> np.ndarray:
    """Hashes of the words of a text, in order; none for a null."""
    data = (text.encode() if isinstance(text, str) else text) or b""
    raw = np.frombuffer(data, np.uint8)
    if lower:
        raw = LOWER[raw]
    return hashes(raw, *spans(raw))


class Sequence:
    """Hashes of any run of words of one text, from one prefix sum."""

    def __init__(self, h: np.ndarray, base: int = WORD_BASE):
        self.up, self.down = powers(base, len(h))
        self.total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * self.up[: len(h)], out=self.total[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.total[ends] - self.total[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))

    def grams(self, k: int) -> np.ndarray:
        n = len(self.total) - k
        if n <= 0:
            return np.empty(0, np.uint64)
        return mix((self.total[k:] - self.total[:n]) * self.down[:n] + np.uint64(k))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
