"""The weighted tree of shards."""

import hashlib
import math
import zlib
from collections import Counter
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from boutlens.llm import shards


def pick(key, tree):
    """Descend by hand."""
    key, below, node = "-" if key is None else str(key), shards.children(tree), ""
    for _ in range(3):
        draws = {p: -math.log((int(hashlib.md5(f"{key}|{p}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13) / w for p, w in below[node].items()}
        node = min(draws, key=draws.get)
    return int(node.rsplit("/", 1)[1])


def placed(spark, tree, n=4000):
    ids = spark.range(n).select(F.col("id").alias("doc_id"))
    return {r[0]: r[1] for r in ids.select("doc_id", shards.choose(shards.key_of(F.col("doc_id")), tree)).collect()}


def test_rows_against_the_descent_by_hand(make):
    rows = [(i * 7, "text ü " * (i % 40), "en", "hot") for i in range(600)] + [(None, None), (None, "x"), (7, "same id"), (7, "same id"), (9, ""), (10, "long " * 50000)]
    docs = make(rows).withColumn("shard", F.lit("clash")).withColumn("_part", F.lit(1))
    got = shards.assign(docs.repartition(7), shards.layout(8), shards.layout(9)).collect()
    assert len(got) == len(rows)
    raw = lambda t: (t or "").encode()
    want = Counter((d, len(raw(t)) + 1, zlib.crc32(raw(t)), pick(d, shards.layout(8)), pick(d, shards.layout(9))) for d, t, *_ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.grown_shard) for r in got) == want
    for s in range(8):
        own = sorted((r for r in got if r.shard == s), key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own)))
        order = [(r.doc_id is not None, r.doc_id or 0, r.text_crc32) for r in own]
        assert order == sorted(order)
    assert all(r.law == "key" and r.grown_shard in (r.shard, 8) for r in got)


@pytest.mark.parametrize("n", [8, 9, 10, 13])
def test_one_more_shard_takes_rows_only_into_itself(spark, n):
    old, new = placed(spark, shards.layout(n)), placed(spark, shards.layout(n + 1))
    moved = [k for k in old if old[k] != new[k]]
    assert all(new[k] == n for k in moved) and abs(len(moved) / len(old) - 1 / (n + 1)) < 0.03


def test_rows_follow_the_weights(spark):
    tree = [replace(s, weight=w) for s, w in zip(shards.layout(8), (1, 2, 3, 4, 0, 1, 5, 4), strict=True)]
    count = Counter(placed(spark, tree).values())
    assert 4 not in count
    for s in tree:
        assert abs(count[s.shard] / 4000 - s.weight / 20) < 0.03


def test_a_changed_weight_moves_rows_only_in_and_out_of_its_subtrees(spark):
    tree = shards.layout(8)
    heavier = [replace(s, weight=3.0) if s.shard == 5 else s for s in tree]
    old, new = placed(spark, tree), placed(spark, heavier)
    where = {s.shard: s.path for s in tree}
    for k in old:
        if old[k] != new[k]:
            a, b = where[old[k]], where[new[k]]
            level = next(i for i in range(3) if a[i] != b[i])
            assert b[level] == where[5][level], (a, b)
    assert placed(spark, list(reversed(tree))) == old


def test_moves_are_counted(spark, make):
    docs = make([(i, "abc") for i in range(300)])
    got = {(r.shard, r.new_shard): (r["rows"], r.bytes) for r in shards.moves(docs, shards.layout(8), shards.layout(9)).collect()}
    old, new = placed(spark, shards.layout(8), 300), placed(spark, shards.layout(9), 300)
    want = Counter((old[k], new[k]) for k in old if old[k] != new[k])
    assert got == {p: (n, 3 * n) for p, n in want.items()}


def test_no_rows_and_no_weights(make):
    assert shards.assign(make([]), shards.layout(8), shards.layout(9)).collect() == []
    none = [replace(s, weight=0.0) for s in shards.layout(2)]
    assert [r.shard for r in shards.assign(make([(1, "a")]), none, shards.layout(2)).collect()] == [None]
