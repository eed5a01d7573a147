"""Order inside groups of any size: rows in sorted ranges, one small row per (group, range) carried on.

A group with a third of all rows lies in many ranges and never meets in one task; edges follow the measured amounts of rows,
since Spark samples the keys.  Windows over a group run over its ranges only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boutlens.session import materialize

#: how totals of one range and of the next are combined; null is the total of no rows
TOTALS = {"sum": (F.sum, lambda a, b: F.coalesce(a + b, a, b)), "max": (F.max, F.greatest), "min": (F.min, F.least)}


def in_order(df: DataFrame, group: list[str], order: list[str], label: str) -> DataFrame:
    """``df`` sorted by (group, order) in ranges and written, with ``_part`` (range) and ``_row`` (rising; without gaps in a range).

    Rows alike in all these columns keep some order that is fixed from then on.
    """
    keys = [F.col(c).asc_nulls_first() for c in (*group, *order, "_tie")]
    rows = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    return materialize(rows.drop("_tie").withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}), label)


def _greatest(kind: str, a: Column, b: Column) -> Column:
    """`greatest` and `least` skip nulls for plain values, and are spelt out for structs, which they don't take."""
    if kind == "sum":
        return TOTALS[kind][1](a, b)
    better = (a >= b) if kind == "max" else (a <= b)
    return F.when(b.isNull(), a).when(a.isNull(), b).when(better, a).otherwise(b)


def running(rows: DataFrame, group: list[str], totals: dict[str, tuple[str, Column]], inclusive: bool = True) -> DataFrame:
    """``rows`` of `in_order` with totals over the group's rows up to each row (or before it): name -> ("sum", "max" or "min", column).

    Null where no row counts.
    """
    rows = rows.withColumns({f"_v_{k}": c for k, (_, c) in totals.items()})
    per_run = rows.groupBy(*group, "_part").agg(*(TOTALS[kind][0](f"_v_{k}").alias(f"_c_{k}") for k, (kind, _) in totals.items()))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    per_run = per_run.select(*group, "_part", *(TOTALS[kind][0](f"_c_{k}").over(earlier).alias(f"_b_{k}") for k, (kind, _) in totals.items()))
    found = per_run.withColumnsRenamed({k: f"_of_{k}" for k in (*group, "_part")})
    same = F.col("_part") == F.col("_of__part")
    for k in group:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    out = rows.join(found, same).drop(*(f"_of_{k}" for k in (*group, "_part")))
    inside = Window.partitionBy(*group, "_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = out.withColumns({f"_i_{k}": TOTALS[kind][0](f"_v_{k}").over(inside) for k, (kind, _) in totals.items()})
    out = out.withColumns({k: _greatest(kind, F.col(f"_b_{k}"), F.col(f"_i_{k}")) for k, (kind, _) in totals.items()})
    return out.drop(*(f"{p}_{k}" for k in totals for p in ("_v", "_b", "_i")))
