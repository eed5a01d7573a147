"""Bouts of orders of any size against plain Python."""

import datetime as dt

from pyspark.sql import types as T

from boutlens.sources import tables


def _lines(order, n, line):
    return [(order, 1 + (i * 7919) % n, line(i), float(i % 50)) for i in range(n)]


def test_orders_of_any_size_have_all_bouts_and_unique_ids(spark, tmp_path):
    data = (_lines(1, 9001, lambda i: 1 + i % 7) + _lines(2, 5000, lambda i: 1 + i) + _lines(3, 300, lambda i: 1 + i)
            + _lines(4, 3, lambda i: 1 + i) + _lines(5, 1, lambda i: 1))
    schema = T.StructType([T.StructField("l_orderkey", T.LongType()), T.StructField("l_suppkey", T.LongType()),
                           T.StructField("l_linenumber", T.LongType()), T.StructField("l_extendedprice", T.DoubleType())])
    spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    orders = [(k, dt.date(1999, 1, k), "5-LOW", 1, 1.0) for k in range(1, 6)]
    spark.createDataFrame(orders, "o_orderkey long, o_orderdate date, o_orderpriority string, o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    want = {}
    for k in range(1, 6):
        who = [s for _, s in sorted((ln, s) for o, s, ln, _ in data if o == k)]
        for pair in range(len(who) // 2):
            want[k, who[2 * pair], who[2 * pair + 1]] = (pair // 101) * 6 * 101 + k * 101 + pair % 101
    rows = tables.build_bouts(spark, str(tmp_path)).collect()
    got = {(r.bout_date.day, r.a_id, r.b_id): r.bout_id for r in rows}
    assert got == want and len(rows) == len(want) == len(set(got.values()))
