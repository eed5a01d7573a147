"""Adapters that read bouts, competitors, odds and ledgers out of the star-schema tables.

Operators never depend on this module: they take generic DataFrames.  It exists so
that each operator can run over the supplied tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boutlens.functions import text as T
from boutlens.session import stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: ids next to each other that one order gives to its bouts; a prime, so that ids stay spread under any modulus
PAIRS_PER_ORDER = 101
#: suppliers of an order that one window numbers; larger orders are numbered in blocks
BLOCK_BITS = 12


def bout_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored bout table.  History needs it in three passes, so it is written once."""
    return stored(spark, f"bouts{sf_dir}", lambda: build_bouts(spark, sf_dir))


def _legs(lines: DataFrame) -> DataFrame:
    """Lines summed per (order, supplier)."""
    return lines.groupBy("l_orderkey", "l_suppkey").agg(
        F.min("l_linenumber").alias("ln"),
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("score"))


def long_orders(lines: DataFrame) -> DataFrame:
    """Orders of more than 2**``BLOCK_BITS`` lines; there is at most one for so many rows."""
    return lines.groupBy("l_orderkey").agg(F.count("*").alias("k")).filter(F.col("k") > 2 ** BLOCK_BITS).select("l_orderkey")


def numbered(lines: DataFrame) -> list[DataFrame]:
    """`_legs` with ``rn``, the place from 0 in the order (ln, l_suppkey) of each l_orderkey: orders of few lines, of few suppliers, and large ones.

    Orders of up to 2**``BLOCK_BITS`` lines are shuffled once, by order: the sums, the window and what follows by order need no other.
    Lines of the others are summed before they are shuffled.  Of these, orders of up to 2**``BLOCK_BITS`` suppliers are numbered by one
    window.  Larger ones are counted at the levels block of line numbers, line number, block of suppliers, so no window runs over a
    whole order.  The ids of `long_orders` are the only thing that is broadcast.
    """
    order = Window.partitionBy("l_orderkey").orderBy("ln", "l_suppkey")
    place = (F.row_number().over(order) - 1).cast("long")
    many = F.broadcast(long_orders(lines))
    few = _legs(lines.join(many, "l_orderkey", "left_anti").repartition("l_orderkey")).withColumn("rn", place)

    legs = _legs(lines.join(many, "l_orderkey", "left_semi"))
    large = legs.groupBy("l_orderkey").agg(F.count("*").alias("k")).filter(F.col("k") > 2 ** BLOCK_BITS).select("l_orderkey")
    small = legs.join(F.broadcast(large), "l_orderkey", "left_anti").withColumn("rn", place)

    levels = ["l_orderkey", "_lines", "ln", "_supps"]
    rows = legs.join(F.broadcast(large), "l_orderkey", "left_semi").withColumns(
        {"_lines": F.shiftright("ln", BLOCK_BITS), "_supps": F.shiftright("l_suppkey", BLOCK_BITS)})
    counts = [rows.groupBy(*levels).agg(F.count("*").alias("k"))]
    for n in (3, 2):
        counts.append(counts[-1].groupBy(*levels[:n]).agg(F.sum("k").alias("k")))
    starts = None
    for n, level in zip((2, 3, 4), reversed(counts), strict=True):
        before = Window.partitionBy(*levels[:n - 1]).orderBy(levels[n - 1]).rowsBetween(Window.unboundedPreceding, -1)
        level = level.select(*levels[:n], F.coalesce(F.sum("k").over(before), F.lit(0)).alias("start"))
        if starts is not None:
            above = starts.withColumnRenamed("start", "above")
            level = level.join(above, levels[:n - 1]).select(*levels[:n], (F.col("start") + F.col("above")).alias("start"))
        starts = level
    inside = F.row_number().over(Window.partitionBy(*levels).orderBy("l_suppkey"))
    placed = rows.withColumn("_in", inside).join(starts, levels).select(*legs.columns, (F.col("_in") - 1 + F.col("start")).alias("rn"))
    return [few, small, placed]


def build_bouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per bout: suppliers of an order meet in pairs (1-2, 3-4, ..), the larger sum wins.

    Lines of long orders are summed per (order, supplier) before the shuffle, so an order with any number of lines stays small.  The
    two sides are paired by the window that numbers them, in large orders by an aggregate, without a self join.  A last supplier without an opponent has no bout.

    Ids: order * 101 + pair for the first 101 pairs of an order; each next 101 pairs are moved on by the ids of all orders,
    so ids are unique for any number of pairs (those beyond the first 101 change when a larger order key comes in).
    """
    lines = table(spark, sf_dir, "lineitem")
    first = F.col("rn") % 2 == 0
    few, small, large = numbered(lines)
    order = Window.partitionBy("l_orderkey").orderBy("rn")
    beside = [placed.withColumns({"b_id": F.lead("l_suppkey").over(order), "b_score": F.lead("score").over(order)}).filter(first).select(
        "l_orderkey", F.floor(F.col("rn") / 2).alias("pair"), F.col("l_suppkey").alias("a_id"), "b_id", F.col("score").alias("a_score"), "b_score") for placed in (few, small)]
    far = large.groupBy("l_orderkey", F.floor(F.col("rn") / 2).alias("pair")).agg(
        F.max(F.when(first, F.col("l_suppkey"))).alias("a_id"),
        F.max(F.when(~first, F.col("l_suppkey"))).alias("b_id"),
        F.max(F.when(first, F.col("score"))).alias("a_score"),
        F.max(F.when(~first, F.col("score"))).alias("b_score"))
    pairs = [p.filter(F.col("b_id").isNotNull()) for p in (*beside, far)]
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.to_date("o_orderdate").alias("bout_date"),
        F.col("o_orderpriority").alias("priority"))
    # each kind of order is joined by itself, so that the first keeps its distribution
    long = orders.join(F.broadcast(long_orders(lines)), "l_orderkey", "left_semi")
    joined = pairs[0].join(orders, "l_orderkey").unionByName(pairs[1].join(long, "l_orderkey")).unionByName(pairs[2].join(long, "l_orderkey"))
    span = (lines.agg(F.max("l_orderkey").cast("long")).scalar() + 1) * PAIRS_PER_ORDER
    number = F.col("l_orderkey") * PAIRS_PER_ORDER + F.col("pair") % PAIRS_PER_ORDER
    number = F.when(F.col("pair") < PAIRS_PER_ORDER, number).otherwise(number + F.floor(F.col("pair") / PAIRS_PER_ORDER) * span)
    joined = joined.withColumn("bout_id", number)
    i = F.col("bout_id")
    side = F.when(F.col("a_score") > F.col("b_score"), "a").when(F.col("b_score") > F.col("a_score"), "b")
    low = F.least("a_score", "b_score")
    finish = (side.isNotNull() & (F.greatest("a_score", "b_score") >= low * 2)).cast("int")
    return joined.select(
        "bout_id", "bout_date", "priority", "a_id", "b_id", "a_score", "b_score",
        side.alias("winner_side"), finish.alias("finish"),
        (finish * (i % 3 == 0).cast("int")).alias("submission"),
        F.when(F.col("priority") == "1-URGENT", 5).otherwise(3).alias("rounds"),
        *[c.alias(n) for n, c in derived(i, F.col("priority")).items()])


def derived(i: Column, priority: Column) -> dict[str, Column]:
    """Bout attributes that follow from the bout id and the order priority."""
    stub = priority == "5-LOW"
    rounds = F.when(priority == "1-URGENT", 5).otherwise(3)
    return {
        "round": (1 + i % rounds).cast("int"),
        "odds_a": F.when(stub, F.lit(1.85)).otherwise((105 + i % 400 * 31 % 400) / 100.0),
        "odds_b": F.when(stub, F.lit(1.85)).otherwise((105 + i % 400 * 53 % 400) / 100.0),
        "blind_pick": F.when(i % 5 <= 1, "X").when(i % 5 <= 3, "Y"),
        "blind_conf": (50 + i % 45 * 7 % 45).cast("int"),
        "held_out": (i % 10 == 3).cast("int"),
    }


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("fid"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))


def bouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`bout_core` with names, winner name, method code and fight key.

    The name joins carry no broadcast hint: Spark broadcasts the dimension only while
    its measured size is under the session threshold, and sorts or hashes beyond it.
    """
    dim = suppliers(spark, sf_dir)
    a = dim.select(F.col("fid").alias("a_id"), F.col("name").alias("fighter_a"), F.col("nation").alias("a_nation"))
    b = dim.select(F.col("fid").alias("b_id"), F.col("name").alias("fighter_b"), F.col("nation").alias("b_nation"))
    df = bout_core(spark, sf_dir).join(a, "a_id").join(b, "b_id")
    return name_columns(df)


def name_columns(df: DataFrame) -> DataFrame:
    i = F.col("bout_id")
    return df.withColumns({
        "winner": F.when(F.col("winner_side") == "a", F.col("fighter_a")).when(
            F.col("winner_side") == "b", F.col("fighter_b")),
        "ai_winner": F.when(i % 3 != 0, F.col("fighter_a")).otherwise(F.col("fighter_b")),
        "method": F.when(F.col("winner_side").isNull(), "TBD").when(F.col("submission") == 1, "SUB")
        .when(F.col("finish") == 1, "KO").when(i % 4 == 0, "SD").when(i % 4 == 1, "MD").otherwise("UD"),
        "fight_key": T.fight_key(F.col("fighter_a"), F.col("fighter_b"), F.col("bout_date")),
    })


def bout_sides(core: DataFrame) -> DataFrame:
    """Two rows per bout, one for each side.  A narrow generator: no shuffle, one scan."""
    def side(flag: int, mine: str) -> Column:
        won = (F.col("winner_side") == mine).cast("int")
        return F.struct(
            F.lit(flag).alias("is_a"), F.col(f"{mine}_id").alias("fid"),
            F.coalesce(won, F.lit(0)).alias("won"),
            F.coalesce(1 - won, F.lit(0)).alias("lost"),
            (F.coalesce(won, F.lit(0)) * F.col("finish")).alias("fin"),
            (F.coalesce(won, F.lit(0)) * F.col("submission")).alias("sub"))

    exploded = core.select("bout_id", "bout_date", "priority", F.explode(F.array(side(1, "a"), side(0, "b"))).alias("s"))
    return exploded.select("bout_id", "bout_date", "priority", "s.*")


def static_stats(fid: Column, nation: Column) -> dict[str, Column]:
    """Slow-moving attributes of a competitor, by exact integer arithmetic."""
    def pct(base: int, mul: int, mod: int) -> Column:
        return (base + fid * mul % mod) / 100.0

    return {
        "dob": F.date_add(F.lit("1963-01-01").cast("date"), (fid * 37 % 5475).cast("int")),
        "dob_quality": F.when(fid % 7 == 0, 0).otherwise(1),
        "td_def": pct(40, 7, 50), "grap_def": pct(40, 11, 50),
        "stress_factor": pct(20, 13, 66), "motivation_index": pct(30, 17, 66),
        "biorythm_score": pct(35, 19, 61), "camp_quality": pct(30, 23, 66),
        "mystic_v2": pct(30, 29, 61),
        "reach_cm": (150 + fid % 76).cast("int"), "height_cm": (150 + fid * 3 % 61).cast("int"),
        "camp_name": F.concat(F.lit("camp_"), (nation % 18).cast("string")),
        "camp_score": F.when(nation % 18 < 16, (30 + nation % 18 * 3) / 100.0).otherwise(F.lit(0.4)),
    }


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated records of competitors from another source, one per (fid, day): what is known of them on the days of their lines."""
    fid = F.col("fid")
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("fid"), F.to_date("l_shipdate").alias("day")).agg(
        F.sum("l_linenumber").cast("int").alias("exp"), F.min("l_linenumber").alias("_low"), F.max("l_linenumber").alias("_high"))
    return lines.select(
        "fid", "day", "exp", F.date_add(F.lit("1960-01-01").cast("date"), (fid * 41 % 5000).cast("int")).alias("dob"),
        F.when(fid % 14 == 0, 0).otherwise(2).alias("dob_quality"), F.concat(F.lit("gym_"), F.col("_high").cast("string")).alias("camp_name"),
        (F.col("_low") + 151).cast("int").alias("reach_cm"), (F.col("_high") + 150).cast("int").alias("height_cm"))


def model_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model bundles: the first 46 values of a vector are weights; means, stds and bias follow the id."""
    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        v.alias("model_id"),
        F.transform(F.slice("embedding", 1, 46), lambda x: x.cast("double")).alias("weights"),
        ((v % 81 - 40) / 100.0).alias("bias"),
        F.transform(F.sequence(F.lit(0), F.lit(45)), lambda j: ((v + j * 7) % 300) / 100.0).alias("means"),
        F.transform(F.sequence(F.lit(0), F.lit(45)), lambda j: ((v + j * 11) % 50) / 10.0).alias("stds"),
        (((v * 7919) % 1000) / 1000.0).alias("accuracy"), "label")
