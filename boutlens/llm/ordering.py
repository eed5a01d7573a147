"""Positions and running totals inside groups of any size.

Rows are cut into ranges of (group, order), sorted there and written.  What a later step needs from the ranges before is
one small row per (group, range), so a group with a third of all rows lies in many ranges and never meets in one task.  The
only windows over a group run over its ranges, as many as there are partitions.

Nulls come first and are a value like any other, in groups and in orders.  Rows alike in group and order are put in some
fixed order of their own; where that could change a result, the caller orders by more columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boutlens.session import materialize

TOTAL = {"sum": (F.sum, lambda a, b: a + b), "xor": (F.bit_xor, lambda a, b: a.bitwiseXOR(b))}


def beside(rows: DataFrame, found: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``rows`` with the other columns of ``found``; null keys are equal."""
    found = found.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return rows.join(found, same, how).drop(*(f"_of_{k}" for k in keys))


def in_order(df: DataFrame, group: list[str], order: list[str], label: str) -> DataFrame:
    """``df`` sorted in ranges and written, with ``_part`` (range) and ``_row`` (rising; without gaps inside a range)."""
    keys = [F.col(c).asc_nulls_first() for c in (*group, *order, "_tie")]
    rows = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    return materialize(rows.drop("_tie").withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()), label)


def _before(group: list[str]):
    return Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)


def runs(rows: DataFrame, group: list[str]) -> DataFrame:
    """One row per (group, range): ``_first``, ``_n`` rows, ``_before`` rows of the group in earlier ranges."""
    out = rows.groupBy(*group, "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    return out.withColumn("_before", F.coalesce(F.sum("_n").over(_before(group)), F.lit(0)))


def numbered(rows: DataFrame, per_run: DataFrame, group: list[str], name: str) -> DataFrame:
    """``rows`` of `in_order` with their place in the group from 0, and whatever else ``per_run`` has for (group, range)."""
    out = beside(rows, per_run, [*group, "_part"])
    return out.withColumn(name, F.col("_row") - F.col("_first") + F.col("_before")).drop("_first", "_n", "_before")


def running(rows: DataFrame, group: list[str], totals: dict[str, tuple[str, Column]]) -> DataFrame:
    """``rows`` of `in_order` with totals over all earlier rows of the group: name -> ("sum" or "xor", long column)."""
    named = {f"_v_{k}": c for k, (_, c) in totals.items()}
    rows = rows.withColumns(named)
    per_run = rows.groupBy(*group, "_part").agg(*(TOTAL[kind][0](f"_v_{k}").alias(f"_c_{k}") for k, (kind, _) in totals.items()))
    for k, (kind, _) in totals.items():
        per_run = per_run.withColumn(f"_b_{k}", F.coalesce(TOTAL[kind][0](f"_c_{k}").over(_before(group)), F.lit(0)))
    out = beside(rows, per_run.drop(*(f"_c_{k}" for k in totals)), [*group, "_part"])
    inside = Window.partitionBy(*group, "_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    for k, (kind, _) in totals.items():
        out = out.withColumn(k, TOTAL[kind][1](F.col(f"_b_{k}"), F.coalesce(TOTAL[kind][0](f"_v_{k}").over(inside), F.lit(0))))
    return out.drop(*(f"_v_{k}" for k in totals), *(f"_b_{k}" for k in totals))


def lookup(rows: DataFrame, found: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``rows`` (with ``_part``) beside the one row of ``found`` for their keys.  A hot key is looked up once per range, and then each
    range joins by itself."""
    pairs = beside(rows.select(*keys, "_part").distinct(), found, keys, how)
    return beside(rows, pairs, [*keys, "_part"])
