"""Data-set audit: missing keys, fill, drift, samples, uniqueness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutlens import constants as K


def _unpivot(df: DataFrame, total: str, columns: list[tuple[str, str, str]]) -> DataFrame:
    """One wide row of counts to (scope, key, n, pct)."""
    items = [F.struct(F.lit(scope).alias("scope"), F.lit(key).alias("key"), F.col(c).alias("n")) for scope, key, c in columns]
    long = df.select(F.col(total).alias("total"), F.inline(F.array(*items)))
    return long.withColumn("pct", F.round(F.col("n") * 100.0 / F.col("total"), 1))


def _lacks(m: Column, key: str) -> Column:
    return F.coalesce(~F.map_contains_key(m, F.lit(key)), F.lit(False))


def _missing(column: str, names: list[str]) -> Column:
    """The keys that a map lacks; null where the map itself is null.

    The map stands once, as an argument: inside a lambda its whole definition would be evaluated for every key.
    """
    return F.array_except(F.array(*[F.lit(k) for k in names]), F.map_keys(column))


def missing_keys(df: DataFrame) -> DataFrame:
    """Counts of absent keys in ``top``, ``stats_a`` and ``stats_b`` (maps of texts), one pass.

    Rows are counted by the set of keys they lack, which combines before the shuffle; only these few groups are unfolded.
    A row without the map is not counted against its keys.
    """
    spec = {"top": K.BOUT_KEYS, "stats_a": K.STAT_KEYS, "stats_b": K.STAT_KEYS}
    groups = df.groupBy(*[_missing(s, names).alias(s) for s, names in spec.items()]).agg(F.count("*").alias("rows"))
    each = F.inline(F.array(*[F.struct(F.lit(s).alias("scope"), F.lit(k).alias("key"), F.array_contains(s, k).alias("lacks"))
                              for s, names in spec.items() for k in names]))
    counted = groups.select("rows", each).groupBy("scope", "key").agg(
        F.coalesce(F.sum(F.when(F.col("lacks"), F.col("rows"))), F.lit(0)).alias("n"), F.sum("rows").alias("total")).filter("n > 0")
    return counted.select("scope", "key", "n", "total", F.round(F.col("n") * 100.0 / F.col("total"), 1).alias("pct"))


def fill_counts(df: DataFrame) -> DataFrame:
    """Null-or-zero and filled counts of the watched fields."""
    a, b, top = F.col("stats_a"), F.col("stats_b"), F.col("top")

    def get(m: Column, k: str) -> Column:
        return F.try_element_at(m, F.lit(k))

    def empty(c: Column) -> Column:
        return c.isNull() | (F.coalesce(c.try_cast("double"), F.lit(1.0)) == 0)

    checks = {
        ("stats_a", "exp empty"): empty(get(a, "exp")), ("stats_a", "fin_rate empty"): empty(get(a, "fin_rate")),
        ("stats_a", "dob filled"): F.coalesce(get(a, "dob") != "", F.lit(False)),
        ("stats_b", "dob filled"): F.coalesce(get(b, "dob") != "", F.lit(False)),
        ("stats_a", "dob_quality filled"): get(a, "dob_quality").isNotNull(),
        ("stats_b", "dob_quality filled"): get(b, "dob_quality").isNotNull(),
        ("top", "ai_factor present"): F.map_contains_key(top, F.lit("ai_factor")),
        ("top", "blind_conf present"): F.map_contains_key(top, F.lit("blind_conf")),
    }
    wide = df.agg(F.count("*").alias("total"), *[F.count_if(c).alias(f"c{i}") for i, c in enumerate(checks.values())])
    return _unpivot(wide, "total", [(s, k, f"c{i}") for i, (s, k) in enumerate(checks)])


def years(df: DataFrame, date_text: Column) -> DataFrame:
    """Rows per year with their share; texts under four characters are left out of the years, not of the total."""
    by_year = df.groupBy(F.when(F.length(date_text) >= 4, F.substring(date_text, 1, 4)).alias("year")).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*")).scalar()
    return by_year.filter(F.col("year").isNotNull()).withColumn("pct", F.round(F.col("n") * 100.0 / total, 1))


def drift(df: DataFrame, expected: list[str] | None = None, head: int | None = None) -> DataFrame:
    """Expected keys with how often they miss (ok, some, many), and unexpected keys, in one pass over all rows.

    Needs ``stats_a`` (map).  With ``head``, unexpected keys are only looked for in the first rows of each file; that
    needs ``pos`` (position in the file).
    """
    expected = expected if expected is not None else sorted(K.EXPECTED_FIELDS)
    m = F.col("stats_a")
    wide = df.agg(F.count("*").alias("total"), *[F.count_if(_lacks(m, k)).alias(f"c{i}") for i, k in enumerate(expected)])
    long = _unpivot(wide, "total", [("expected", k, f"c{i}") for i, k in enumerate(expected)])
    level = F.when(F.col("n") == 0, "ok").when(F.col("n") < F.col("total") * 0.1, "some").otherwise("many")
    found = long.select("key", "n", level.alias("level"))
    extra = (df if head is None else df.filter(F.col("pos") < head)).select(F.explode(F.map_keys(m)).alias("key")).filter(~F.col("key").isin(expected))
    return found.unionByName(extra.groupBy("key").agg(F.count("*").alias("n")).withColumn("level", F.lit("unexpected")))


def samples(df: DataFrame, file: str, pos: str) -> DataFrame:
    """First, middle and last row of every file, from the stored position: no window needed."""
    sizes = df.groupBy(file).agg(F.count("*").alias("_n"))
    joined = df.join(sizes, file)
    label = (F.when(F.col(pos) == 0, "first").when(F.col(pos) == F.floor(F.col("_n") / 2), "middle")
             .when(F.col(pos) == F.col("_n") - 1, "last"))
    return joined.withColumn("label", label).filter(F.col("label").isNotNull()).withColumnRenamed("_n", "rows_in_file")


def file_sizes(df: DataFrame) -> DataFrame:
    """Rows and bytes per source file, for frames read with the ``_metadata`` column."""
    return df.groupBy(F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_size").alias("bytes")).agg(
        F.count("*").alias("n"))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once; counts are combined before the shuffle."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def key_violations(checks: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """(relation, key, value, n) of values that occur more than once where they must be unique; missing values may repeat.

    Counts are combined before the shuffle, one row per distinct value.
    """
    parts = [duplicates(df.filter(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("value")), ["value"]).select(
        F.lit(relation).alias("relation"), F.lit(key).alias("key"), "value", "n") for relation, df, key in checks]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
