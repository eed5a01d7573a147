"""Names of the caller's columns, kept apart from those that an operator makes for itself."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def set_aside(rows: DataFrame, used: Iterable[str], results: Iterable[str] = ()) -> tuple[DataFrame, list[Column]]:
    """``rows`` with the columns that an operator doesn't use renamed to ``caller_0``, ``caller_1``, ..., and the columns that give all names back.

    Columns named like ``results`` go, since the results replace them; names are compared as Spark does, without case.  A renaming is no
    work: Spark drops it from the plan, and columns that nobody reads are still pruned.
    """
    used, gone = set(used), {c.lower() for c in results}
    there, back = [], []
    for k, name in enumerate(rows.columns):
        quoted = "`" + name.replace("`", "``") + "`"
        if name in used:
            there.append(F.col(quoted))
            back.append(F.col(quoted))
        elif name.lower() not in gone:
            there.append(F.col(quoted).alias(f"caller_{k}"))
            back.append(F.col(f"caller_{k}").alias(name))
    return rows.select(*there), back
