"""Shards as the leaves of a weighted tree of regions and racks.

A row descends from the top: at each node every child draws -ln(u) / weight, with u a hash of the row's key and the child's path,
and the least draw wins, so children get rows in proportion to their weights.  A draw depends on the row, the child and
its weight only.  If one weight changes, the rows that change place at a node all move into that child (it grew) or out of
it (it shrank): other children trade nothing with each other, and subtrees with unchanged weights keep what they keep.

`layout` opens a region of its own for each shard beyond the base, so one more shard takes rows only into itself.  Adding a
shard to an old rack instead makes the rack and the region heavier, and their old shards gain too.

The descent is one projection per level.  Places in a shard are counted in ranges (`ordering`), so that no shard meets in
one task.

Defined cases: a null key is a key like others, written ``-``; a null text has no bytes, as an empty one; rows with equal
keys share a shard and are ordered by text; repeated rows are rows of their own; an empty table gives no
rows; children without weight are left out; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutlens.llm.ordering import in_order, numbered, runs
from boutlens.session import materialize

DIGITS = 13


@dataclass(frozen=True)
class Shard:
    region: int
    rack: int
    shard: int
    weight: float = 1.0

    @property
    def path(self) -> tuple[str, str, str]:
        return f"{self.region}", f"{self.region}/{self.rack}", f"{self.region}/{self.rack}/{self.shard}"


Tree = list[Shard]


def layout(shards: int, base: int = 8, per_rack: int = 2, racks: int = 2) -> Tree:
    """Shards 0, 1, ..: the first ``base`` fill racks and regions, each further one is a region of its own."""
    per_region = per_rack * racks
    regions = -(-base // per_region)
    inside = [Shard(i // per_region, i // per_rack, i) for i in range(min(shards, base))]
    return inside + [Shard(regions + i - base, regions * racks + i - base, i) for i in range(base, shards)]


def children(tree: Tree) -> dict[str, dict[str, float]]:
    """The paths below each path, with the weight of all shards under them."""
    out: dict[str, dict[str, float]] = {}
    for s in tree:
        for up, down in zip(("", *s.path[:2]), s.path, strict=True):
            below = out.setdefault(up, {})
            below[down] = below.get(down, 0.0) + max(0.0, s.weight)
    return {up: {p: w for p, w in below.items() if w > 0} for up, below in out.items()}


def draw(key: Column, path: Column, weight: Column) -> Column:
    number = F.conv(F.substring(F.md5(F.concat(key, F.lit("|"), path).cast("binary")), 1, DIGITS), 16, 10).cast("double")
    return -F.ln((number + 0.5) / float(16**DIGITS)) / weight


def choose(key: Column, tree: Tree) -> Column:
    """The shard of a key; null if no shard has weight."""
    below = children(tree)
    if not below.get(""):
        return F.lit(None).cast("int")
    pairs = {up: F.array(*(F.struct(F.lit(p).alias("path"), F.lit(w).alias("weight")) for p, w in kids.items())) for up, kids in below.items() if kids}
    kids = F.create_map(*(x for up, row in pairs.items() for x in (F.lit(up), row)))
    node = F.lit("")
    for _ in range(3):
        node = F.array_min(F.transform(kids[node], lambda c: F.struct(draw(key, c.path, c.weight).alias("draw"), c.path.alias("path"))))["path"]
    return F.element_at(F.split(node, "/"), -1).cast("int")


def key_of(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("-"))


def assign(docs: DataFrame, tree: Tree, grown: Tree) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and the shard in the grown tree, for all rows."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    key = key_of(F.col("doc_id"))
    rows = docs.select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.lit("key").alias("law"), choose(key, tree).alias("shard"), choose(key, grown).alias("grown_shard"))
    rows = in_order(materialize(rows, "shards-rows"), ["shard"], ["doc_id", "text_crc32", "size"], "shards-sorted")
    placed = numbered(rows, runs(rows, ["shard"]), ["shard"], "slot")
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def moves(docs: DataFrame, old: Tree, new: Tree) -> DataFrame:
    """Rows and bytes that a change of the tree moves, per (shard, new shard)."""
    key = key_of(F.col("doc_id"))
    rows = docs.select(choose(key, old).alias("shard"), choose(key, new).alias("new_shard"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("_b"))
    return rows.where(~F.col("shard").eqNullSafe(F.col("new_shard"))).groupBy("shard", "new_shard").agg(F.count("*").alias("rows"), F.sum("_b").alias("bytes"))
