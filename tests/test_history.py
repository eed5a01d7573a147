"""The history over sorted ranges: competitors over many ranges and batches, and what is shuffled."""

import datetime as dt
import re

import pytest

from boutlens.operators.history import point_in_time
from boutlens.sources import tables
from tests.test_operators import _brute, _sides

SCHEMA = "bout_id long, bout_date date, is_a int, fid long, won int, lost int, fin int, sub int"


@pytest.mark.parametrize("batch,bits", [("1", 3), ("3", 0), ("7", 20)])
def test_counts_are_carried_over_batches_and_ranges(spark, batch, bits):
    rows = _sides(9, 130, hot=0.7, days=60)
    # a row without a day comes first and counts, with no time from it to any day; one without a competitor is left out
    undated = (900, dt.date(1, 1, 1), 1, 3, 1, 0, 0, 0)
    want = {k: (*v[:4], -1 if v[4] > 10000 else v[4], *v[5:]) for k, v in _brute([*rows, undated]).items() if k != (900, 3)}
    extra = [(900, None, *undated[2:]), (901, rows[0][1], 1, None, 1, 0, 0, 0)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        got = {(r["bout_id"], r["fid"]): (r["recent_wins"], r["form"], r["wins"], r["losses"], r["days_off"], r["fights_12m"], r["fin_rate"])
               for r in point_in_time(spark.createDataFrame(rows + extra, SCHEMA), bits).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == want


def test_rows_meet_their_carries_without_a_shuffle(spark):
    """One shuffle puts the rows into ranges; before, each of three levels shuffled them, and two joins did again."""
    plan = point_in_time(spark.createDataFrame(_sides(1, 20), SCHEMA))._jdf.queryExecution().executedPlan().toString()
    joins = re.findall(r"(\w+Join) \[fid#\d+L, _part#\d+\], \[fid#\d+L, _part#\d+\], LeftOuter", plan)
    assert "BroadcastHashJoin" in joins and not re.search(r"Exchange [^\n]*(bout_id|blk|key#)", plan)


def test_lines_of_common_orders_are_shuffled_by_order_only(spark, tmp_path):
    lines = [(o, 1 + (i * 7919) % 40, 1 + i % 9, 1.0) for o, n in ((1, 5000), (2, 8)) for i in range(n)] + [(2, None, 1, 1.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_linenumber long, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    df = spark.read.parquet(f"{tmp_path}/lineitem.parquet")
    few, small, large = tables.numbered(df)
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(l_orderkey" in plan and not re.search(r"Exchange hashpartitioning\(l_orderkey#\d+L, l_suppkey", plan)
    got = {r.l_orderkey: set() for r in few.unionByName(small).unionByName(large).collect()}
    for r in few.unionByName(small).unionByName(large).collect():
        got[r.l_orderkey].add((r.rn, r.l_suppkey))
    want = {}
    for o in (1, 2):
        first = {}
        for k, s, ln, _ in lines:
            if k == o:
                first[s] = min(ln, first.get(s, ln))
        want[o] = set(enumerate(sorted(first, key=lambda s: (first[s], s is not None, s or 0))))
    assert got == want and large.count() == 0 and small.count() == 40
