"""A manifest of documents as a hash tree of SHA-256 midstates.

A digest as hex text is exactly one block of SHA-256, so the state of a parent before each child slot is eight words.
Parents keep a copy of these states.  To fold a changed leaf into the root, each parent resumes the state of the leaf's slot
with the replacement and reads the siblings to the right only; what lies to the left is never read again.

Leaves are numbered per source in ranges (`ordering`).  A unit is a run of ``FAN ** HEIGHT`` neighbours of one tree: a task builds some
units, level by level, and writes for each unit its digests and states.  The roots of the units are the input of the
next stage, until each source has one root; the roots of the sources are the leaves of the last tree.  On the way down, each
unit gets its path: the runs above it and its states in them.  So the work of a leaf is one unit and a path, wherever it lies,
and a source with a third of all rows is many units.

Defined cases: nulls are written as ``-`` and come first in any order; an empty text is ``0:``; texts are hashed whole by Spark; rows
with equal ids are in the order of their leaf; repeated rows are leaves of their own; a null id is never
tampered with; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutlens.llm.ordering import beside, in_order, numbered, runs
from boutlens.session import materialize

FAN, HEIGHT = 16, 2
SPAN = FAN**HEIGHT
#: leaves that a task holds at once, on average
BUNDLE = 4096
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

PRIMES = [p for p in range(2, 312) if all(p % q for q in range(2, p))]


def _fraction(p: int, root: int) -> int:
    """The first 32 bits of the fraction of a root of p."""
    x = int((p << (32 * root)) ** (1 / root))
    while x**root > p << (32 * root):
        x -= 1
    while (x + 1) ** root <= p << (32 * root):
        x += 1
    return x & 0xFFFFFFFF


START = np.array([_fraction(p, 2) for p in PRIMES[:8]], np.uint32)
ROUNDS = np.array([_fraction(p, 3) for p in PRIMES], np.uint32)
HEX = np.frombuffer("".join(f"{i:02x}" for i in range(256)).encode(), np.uint8).reshape(256, 2)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def resume(state: np.ndarray, words: np.ndarray) -> np.ndarray:
    """States (n, 8) after one more block each (n, 16)."""
    w = [np.ascontiguousarray(words[:, i]) for i in range(16)]
    for i in range(16, 64):
        a, b = w[i - 15], w[i - 2]
        w.append(w[i - 16] + (_turn(a, 7) ^ _turn(a, 18) ^ (a >> np.uint32(3))) + w[i - 7] + (_turn(b, 17) ^ _turn(b, 19) ^ (b >> np.uint32(10))))
    a, b, c, d, e, f, g, h = (np.ascontiguousarray(state[:, i]) for i in range(8))
    for i in range(64):
        one = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + ROUNDS[i] + w[i]
        two = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return state + np.stack([a, b, c, d, e, f, g, h], axis=1)


def block(digests: np.ndarray) -> np.ndarray:
    """Digests (n, 32) as the one block of their hex text."""
    return HEX[digests].reshape(-1, 64).view(">u4").astype(np.uint32)


def finish(state: np.ndarray, children: np.ndarray) -> np.ndarray:
    """Digests (n, 32) of states that have taken in so many children."""
    last = np.zeros((len(state), 16), np.uint32)
    last[:, 0] = 0x80000000
    last[:, 15] = children * 512
    return resume(state, last).astype(">u4").view(np.uint8)


def parents(digests: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the parents of runs of children, and the state before each child."""
    before = np.empty((len(digests), 8), np.uint32)
    state = np.tile(START, (len(first), 1))
    for slot in range(int(size.max(initial=0))):
        on = size > slot
        at = first[on] + slot
        before[at] = state[on]
        state[on] = resume(before[at], block(digests[at]))
    return finish(state, size), before


def fold(value: np.ndarray, before: np.ndarray, digests: np.ndarray, at: np.ndarray, end: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Digests of the parents where child ``at`` of each has the digest ``value`` instead: its slot's state, the value, the right siblings."""
    state = resume(before, block(value))
    for step in range(1, int((end - at).max(initial=1))):
        on = at + step < end
        state[on] = resume(state[on], block(digests[at[on] + step]))
    return finish(state, size)


def _bytes(cells, width: int = 32) -> np.ndarray:
    return np.frombuffer(b"".join(cells), np.uint8).reshape(-1, width)


def _states(cells) -> np.ndarray:
    return _bytes(cells).view("<u4").astype(np.uint32)


def _levels(n: np.ndarray) -> np.ndarray:
    """Levels that a unit of a tree with n inputs climbs: to the one root, at most ``HEIGHT``."""
    return sum((n > FAN**i).astype(int) for i in range(HEIGHT))


def _unit() -> Column:
    return F.expr(f"pos div {SPAN}")


UNIT = "tree long, unit long, n long, digest binary, digests array<binary>, states array<binary>"


def _build(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values(["tree", "pos"], ignore_index=True)
    unit = frame["pos"].to_numpy() // SPAN
    heads = np.flatnonzero(np.r_[True, (np.diff(frame["tree"].to_numpy()) != 0) | (np.diff(unit) != 0)])
    levels = _levels(frame["n"].to_numpy()[heads])
    now, owner = _bytes(frame["digest"]), np.repeat(np.arange(len(heads)), np.diff(np.r_[heads, len(frame)]))
    place = frame["pos"].to_numpy() % SPAN
    kept: list[list[bytes]] = [[] for _ in heads]
    states: list[list[bytes]] = [[] for _ in heads]
    root = [b""] * len(heads)
    for level in range(HEIGHT + 1):
        done = levels[owner] == level
        for u, d in zip(owner[done], now[done], strict=True):
            root[u] = d.tobytes()
        now, owner, place = now[~done], owner[~done], place[~done]
        if not len(now):
            break
        first = np.flatnonzero(np.r_[True, (np.diff(owner) != 0) | (np.diff(place // FAN) != 0)])
        up, before = parents(now, first, np.diff(np.r_[first, len(now)]))
        cuts = np.flatnonzero(np.r_[True, np.diff(owner) != 0, True])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            kept[owner[a]].append(now[a:b].tobytes())
            states[owner[a]].append(before[a:b].astype("<u4").tobytes())
        now, owner, place = up, owner[first], place[first] // FAN
    return pd.DataFrame({"tree": frame["tree"].to_numpy()[heads], "unit": unit[heads], "n": frame["n"].to_numpy()[heads], "digest": root, "digests": kept, "states": states})


def _bundle(tasks: int) -> Column:
    return F.pmod(F.xxhash64("tree", "unit"), F.lit(tasks))


def grow(inputs: DataFrame, label: str) -> tuple[list[DataFrame], DataFrame]:
    """The stages of all trees over ``inputs`` (tree, n inputs of the tree, pos, digest), as tables of units; and (tree, digest) of the roots."""
    stages, roots = [], None
    while True:
        tasks = max(1, inputs.count() // BUNDLE)
        rows = inputs.select("tree", "n", "pos", "digest", _unit().alias("unit"))
        units = materialize(rows.groupBy(_bundle(tasks).alias("_bundle")).applyInPandas(_build, UNIT), f"manifest-{label}-{len(stages)}")
        stages.append(units)
        over = units.where(F.col("n") <= SPAN).select("tree", "digest")
        roots = over if roots is None else roots.unionByName(over)
        if units.where(F.col("n") > SPAN).isEmpty():
            return stages, roots
        inputs = units.where(F.col("n") > SPAN).select("tree", F.ceil(F.col("n") / SPAN).cast("long").alias("n"), F.col("unit").alias("pos"), "digest")


PATH = "path array<struct<slot: int, run: binary, state: binary>>"


def _downwards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each input of each unit the runs above it."""
    for frame in batches:
        for u in frame.itertuples(index=False):
            above = [e if isinstance(e, dict) else e.asDict() for e in u.path]
            count = len(u.digests[0]) // 32 if len(u.digests) else 1
            paths = []
            for i in range(count):
                own = []
                for digests, states in zip(u.digests, u.states, strict=True):
                    a = i // FAN * FAN
                    own.append({"slot": i % FAN, "run": digests[a * 32 : (a + FAN) * 32], "state": states[i * 32 : i * 32 + 32]})
                    i //= FAN
                paths.append(own + above)
            yield pd.DataFrame({"tree": u.tree, "pos": np.arange(count) + u.unit * SPAN, "path": paths, "subroot": [u.subroot] * count, "root": [u.root] * count})


def descend(stages: list[DataFrame], start: DataFrame, label: str) -> DataFrame:
    """The first stage's units with the path above each, from the last stage downwards.

    ``start`` (tree, path, subroot, root) holds what lies above the root of each tree.
    """
    below = None
    for g in range(len(stages) - 1, -1, -1):
        tops = beside(stages[g].where(F.col("n") <= SPAN), start, ["tree"])
        units = tops if below is None else tops.unionByName(beside(stages[g].where(F.col("n") > SPAN), below, ["tree", "unit"]))
        if not g:
            return units
        below = materialize(units.select("tree", "unit", "digests", "states", "path", "subroot", "root").mapInPandas(_downwards, f"tree long, pos long, {PATH}, subroot binary, root binary"), f"manifest-{label}-{g}")
        below = below.withColumnRenamed("pos", "unit")


#: ids pass through pandas as text, since a null would turn a column of integers into one of floats
RESULT = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _fold(rows: pd.DataFrame, units: pd.DataFrame) -> pd.DataFrame:
    """Proof and folded root of each leaf of a bundle."""
    if not len(rows):
        return pd.DataFrame(columns=[c.split()[0] for c in RESULT.split(", ")])
    units = units.sort_values(["tree", "unit"], ignore_index=True)
    rows = rows.sort_values(["tree", "pos"], ignore_index=True)
    which = units.set_index(["tree", "unit"]).index.get_indexer(pd.MultiIndex.from_arrays([rows["tree"], rows["pos"] // SPAN]))
    leaf = _bytes(rows["leaf"])
    value = _bytes(np.where(rows["altered"].isna(), rows["leaf"], rows["altered"])).copy()
    place = rows["pos"].to_numpy() % SPAN
    proofs: list[list[bytes]] = [[] for _ in range(len(rows))]
    for level in range(HEIGHT):
        has = [len(d) > level for d in units["digests"]]
        blobs = [d[level] if h else b"" for d, h in zip(units["digests"], has, strict=True)]
        digests, before = _bytes(blobs), _states([s[level] if h else b"" for s, h in zip(units["states"], has, strict=True)])
        size = np.array([len(b) // 32 for b in blobs])
        offset = np.cumsum(size) - size
        on = np.flatnonzero(size[which])
        first = offset[which[on]] + place[on] // FAN * FAN
        end = np.minimum(first + FAN, (offset + size)[which[on]])
        at = offset[which[on]] + place[on]
        value[on] = fold(value[on], before[at], digests, at, end, end - first)
        text = HEX[digests].tobytes()
        for r, a, b, c in zip(on.tolist(), (first * 64).tolist(), (at * 64).tolist(), (end * 64).tolist(), strict=True):
            proofs[r].append(text[a:b] + text[b + 64 : c])
        place = place // FAN
    paths = [[(e["slot"], e["run"], e["state"]) if isinstance(e, dict) else (e.slot, e.run, e.state) for e in p] for p in units["path"]]
    shared = [b"".join(r[: 32 * s].hex().encode() + r[32 * s + 32 :].hex().encode() for s, r, _ in p) for p in paths]
    for depth in range(max(map(len, paths))):
        have = [p[depth] if len(p) > depth else (0, b"", b"\0" * 32) for p in paths]
        digests, before = _bytes([r for _, r, _ in have]), _states([s for _, _, s in have])
        slot, size = np.array([s for s, _, _ in have]), np.array([len(r) // 32 for _, r, _ in have])
        offset = np.cumsum(size) - size
        on = np.flatnonzero(size[which])
        u = which[on]
        value[on] = fold(value[on], before[u], digests, offset[u] + slot[u], offset[u] + size[u], size[u])
    root = _bytes(units["root"])
    return pd.DataFrame({
        "doc_id": rows["doc_id"],
        "leaf": [d.tobytes().hex() for d in leaf],
        "subroot": [units["subroot"][u].hex() for u in which],
        "root": [units["root"][u].hex() for u in which],
        "proof_sha256": [hashlib.sha256(b"".join(p) + shared[u]).hexdigest() for p, u in zip(proofs, which, strict=True)],
        "folded_root": [d.tobytes().hex() for d in value],
        "verified": (value == root[which]).all(axis=1),
    })


def field(c: Column) -> Column:
    text = c.cast("string")
    return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(text: Column) -> Column:
    """The leaf's digest, with this text."""
    return F.unhex(F.sha2(F.concat(*(field(F.col(c)) for c in FIELDS[:-1]), field(text)).cast("binary"), 256))


def tampered() -> Column:
    """Every fifth id by its checksum; a null id is not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def lowered(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def leaves(docs: DataFrame, changed: Column, change: Column) -> DataFrame:
    """(doc_id, source, leaf, altered): the leaf of each row, and of what ``change`` makes of the text where ``changed`` holds."""
    docs = docs.select(*FIELDS)
    return docs.select("doc_id", "source", leaf(F.col("text")).alias("leaf"), F.when(changed, leaf(change)).alias("altered"))


def verify(docs: DataFrame, changed: Column, change: Column) -> DataFrame:
    """doc_id, leaf, subroot, root and proof of all rows as they are, and the root as folded from the rows as ``change`` leaves them."""
    rows = in_order(materialize(leaves(docs, changed, change), "manifest-leaves"), ["source"], ["doc_id", "leaf"], "manifest-sorted")
    per_run = materialize(runs(rows, ["source"]), "manifest-runs")
    sources = in_order(per_run.groupBy("source").agg(F.sum("_n").alias("n")), [], ["source"], "manifest-sources")
    trees = materialize(numbered(sources, runs(sources, []), [], "tree").select("source", "n", "tree"), "manifest-trees")
    placed = materialize(numbered(rows, beside(per_run, trees, ["source"]), ["source"], "pos").select("tree", "n", "pos", "doc_id", "leaf", "altered"), "manifest-placed")

    stages, subroots = grow(placed.withColumnRenamed("leaf", "digest"), "source")
    top = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), "digest")
    tops, root = grow(top.withColumn("n", F.lit(trees.count()).cast("long")), "root")
    start = root.select("tree", F.expr("cast(array() as array<struct<slot: int, run: binary, state: binary>>)").alias("path"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    over = descend(tops, start, "root").select("tree", "unit", "digests", "states", "path", "subroot", "root").mapInPandas(_downwards, f"tree long, pos long, {PATH}, subroot binary, root binary")
    over = over.select(F.col("pos").alias("tree"), "path", "root").join(subroots.withColumnRenamed("digest", "subroot"), "tree")
    units = descend(stages, materialize(over, "manifest-subroots"), "source")

    tasks = max(1, placed.count() // BUNDLE)
    bundled = placed.withColumn("unit", _unit()).select("tree", "pos", F.col("doc_id").cast("string").alias("doc_id"), "leaf", "altered", _bundle(tasks).alias("_bundle"))
    units = units.select("tree", "unit", "digests", "states", "path", "subroot", "root", _bundle(tasks).alias("_bundle"))
    folded = bundled.groupBy("_bundle").cogroup(units.groupBy("_bundle")).applyInPandas(_fold, RESULT)
    return folded.withColumn("doc_id", F.col("doc_id").cast("long"))
