"""Keeping the bout data set: dedup, upsert, holdout, splits, sampling, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boutlens import constants as K
from boutlens.functions.text import norm_latin
from boutlens.operators.history import global_position, latest


def dedup_first(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key.  The rank filter also prunes before the shuffle, so hot keys stay small."""
    first = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("_rn", first).filter("_rn = 1").drop("_rn")


def completed(df: DataFrame) -> DataFrame:
    return df.filter(F.col("winner").isNotNull())


def month_scan(df: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """Completed bouts of a date range (both ends included), first row per key."""
    if first is not None:
        df = df.filter(F.col("bout_date") >= F.lit(first).cast("date"))
    if last is not None:
        df = df.filter(F.col("bout_date") <= F.lit(last).cast("date"))
    return dedup_first(completed(df), "fight_key", ["bout_date", "bout_id"])


def exclude_holdout(df: DataFrame, holdout: DataFrame, key: str = "fight_key") -> DataFrame:
    """Anti join; Spark broadcasts the keys only when their measured size allows."""
    return df.join(holdout.select(key).distinct(), key, "left_anti")


def upsert(current: DataFrame, pending: DataFrame, key: str, order: list[str], refresh: list[str]) -> DataFrame:
    """Append new keys; for known keys take only the ``refresh`` columns of the last pending row.

    ``current`` must hold one row per key.  Adds ``change``: kept, refreshed or new.
    """
    rest = [c for c in current.columns if c != key and c not in refresh]
    # Ascending order picks the first pending row for new keys, descending the last one for refreshes.
    last = dedup_first(pending, key, [F.col(c).desc() for c in order]).select(
        key, *[F.col(c).alias(f"_p_{c}") for c in refresh], F.lit(True).alias("_sent"))
    first = dedup_first(pending, key, order).select(key, *[F.col(c).alias(f"_n_{c}") for c in rest])
    sent = first.join(last, key)
    merged = current.withColumn("_known", F.lit(True)).join(sent, key, "full_outer")
    known, was_sent = F.coalesce("_known", F.lit(False)), F.coalesce("_sent", F.lit(False))
    return merged.select(
        key, *[F.when(known, F.col(c)).otherwise(F.col(f"_n_{c}")).alias(c) for c in rest],
        *[F.when(was_sent, F.col(f"_p_{c}")).otherwise(F.col(c)).alias(c) for c in refresh],
        F.when(~known, "new").when(was_sent, "refreshed").otherwise("kept").alias("change"))


def stamp_ids(fights: DataFrame, registry: DataFrame) -> DataFrame:
    """Fill missing ``fighter_a_id`` / ``fighter_b_id`` from a pair registry in either orientation.

    The pair is joined on its two normalised names in sorted order, one registry row per pair.
    """
    na, nb = norm_latin(F.col("fighter_a")), norm_latin(F.col("fighter_b"))
    keyed = fights.withColumns({"_lo": F.least(na, nb), "_hi": F.greatest(na, nb), "_direct": na <= nb})
    reg = registry.select(
        F.least(na, nb).alias("_lo"), F.greatest(na, nb).alias("_hi"),
        F.when(na <= nb, F.col("id_a")).otherwise(F.col("id_b")).alias("_lo_id"),
        F.when(na <= nb, F.col("id_b")).otherwise(F.col("id_a")).alias("_hi_id"),
    ).groupBy("_lo", "_hi").agg(F.min("_lo_id").alias("_lo_id"), F.min("_hi_id").alias("_hi_id"))
    joined = keyed.join(reg, ["_lo", "_hi"], "left")
    a = F.when(F.col("_direct"), F.col("_lo_id")).otherwise(F.col("_hi_id"))
    b = F.when(F.col("_direct"), F.col("_hi_id")).otherwise(F.col("_lo_id"))
    return joined.withColumns({
        "fighter_a_id": F.coalesce("fighter_a_id", a), "fighter_b_id": F.coalesce("fighter_b_id", b),
    }).drop("_lo", "_hi", "_direct", "_lo_id", "_hi_id")


def recent_split(df: DataFrame, pending: int, window: int = K.RECENT_WINDOW) -> DataFrame:
    """Stratum of every row: new (last ``pending``), recent (rest of the last ``window``), historical.

    All pending rows are new, also where there are more of them than the window holds.
    """
    last = latest(df.select("bout_id", "bout_date"), max(window, pending)).select("bout_id", "from_end")
    tagged = df.join(last, "bout_id", "left")
    return tagged.withColumn("stratum", F.when(F.col("from_end") <= pending, "new")
                             .when(F.col("from_end") <= window, "recent").otherwise("historical"))


def eval_slice(df: DataFrame, day: str = "bout_date", ident: str = "bout_id") -> DataFrame:
    """Rows 101 to 200 from the end; with fewer than 10 of those, the last 100."""
    last = latest(df, 200, day, ident)
    rows = F.count("*").over(Window.partitionBy(F.lit(1)))
    wanted = F.when(F.col("_n") - 100 >= 10, F.col("from_end") > 100).otherwise(F.col("from_end") <= 100)
    return last.withColumn("_n", rows).filter(wanted).drop("_n")


def draw(df: DataFrame, k: int, seed: int, key: str) -> DataFrame:
    """``k`` rows without replacement, in the order of md5(seed | key).

    The order depends only on the row, so any partitioning draws the same rows, and a
    top-k needs no full sort.
    """
    ticket = F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))
    return df.withColumn("_t", ticket).orderBy("_t", key).limit(k).drop("_t")


def training_sample(df: DataFrame, pending: int, seed: int = K.TRAIN_SEED, key: str = "bout_id") -> DataFrame:
    """Rows of one training batch with ``is_fresh``.

    All pending rows, recent rows drawn up to 139 in total, and up to 60 historical rows.
    """
    split = recent_split(df, pending)
    new = split.filter("stratum = 'new'")
    extra = draw(split.filter("stratum = 'recent'"), max(0, K.FRESH_TARGET - pending), seed, key)
    old = draw(split.filter("stratum = 'historical'"), K.HISTORICAL_TARGET, seed, key)
    return (new.unionByName(extra).withColumn("is_fresh", F.lit(1))
            .unionByName(old.withColumn("is_fresh", F.lit(0))))


def every_third(df: DataFrame, every: int = 3) -> DataFrame:
    """Flag ``held`` on each third row in (date, id) order."""
    placed = global_position(df, "bout_date", "bout_id")
    return placed.withColumn("held", (F.col("seq") % every == 0).cast("int"))


def batches(df: DataFrame, size: int = K.BATCH_TRAIN_SIZE) -> DataFrame:
    """Batch twin of the count-triggered stream: batch number of every row in (date, id) order."""
    placed = global_position(df, "bout_date", "bout_id")
    return placed.withColumn("batch", F.floor((F.col("seq") - 1) / size))


def fingerprint(df: DataFrame, key: str) -> DataFrame:
    """Row count and an order-free fingerprint of the keys: the sum of 60 bits of each md5.

    A sum needs neither a sort nor a collected list, so it works at any size.
    """
    bits = F.conv(F.substring(F.md5(F.col(key)), 1, 15), 16, 10).cast("decimal(20,0)")
    return df.agg(F.count("*").alias("n"), F.sum(bits).cast("string").alias("fingerprint"))


def pick_positions(df: DataFrame, group: str, order: str, positions: list[int]) -> DataFrame:
    """Rows at zero-based positions of each group; positions out of range match nothing."""
    wanted = sorted(p for p in set(positions) if p >= 0)
    rank = F.row_number().over(Window.partitionBy(group).orderBy(order))
    ranked = df.withColumn("_rn", rank).filter(F.col("_rn") <= (wanted[-1] + 1 if wanted else 0))
    return ranked.withColumn("position", F.col("_rn") - 1).filter(F.col("position").isin(wanted)).drop("_rn")


def mode_guard(day: Column, mode: Column, as_of: str) -> Column:
    """Reason for rejecting a request, or an empty text."""
    today = F.lit(as_of).cast("date")
    return (F.when(day.isNull(), "bad date")
            .when((mode == "predict") & (day < today), "date in the past")
            .when((mode == "train") & (day > today), "date in the future").otherwise(""))
