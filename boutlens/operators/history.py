"""Point-in-time form from a bout history, without one task per competitor.

A plain window ``PARTITION BY competitor`` puts the whole history of one competitor
into one task.  If one competitor holds a third of all rows that task never ends.
Rows are therefore sorted once, by (competitor, day, id), into ranges whose edges Spark
draws by the measured amounts of rows:

* `ranged` shuffles the narrow rows once and counts within each range, batch by batch;
* `carried` adds what earlier ranges hold of the same competitor.  Ranges follow each other,
  so only the first competitor of a range can have begun before it: there is at most one
  carry for each range, with totals, the last five results and the counts of one year of days.

Every row is shuffled once, whatever the number of rows of one competitor.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boutlens.session import materialize

BLOCK_BITS = 20
EPOCH = "1970-01-01"
TAIL = 5
YEAR = 365
#: stands for no day: before all days, and no time from any of them
NO_DAY = -(1 << 30)
COUNTS = ("n", "won", "lost", "fin", "sub")
#: what `carried` adds to a row; all else of a record follows from these (`record`)
STATE = ["n_before", "won_before", "lost_before", "fin_before", "sub_before", "tail", "gap", "year_n"]
#: results in ``tail``, two bits each, the last one lowest; 0 is no result
LETTERS = "-WLD"


def _counter(counts: tuple[str, ...], tail: int, year: int, no_day: int) -> Callable[[Iterator], Iterator]:
    """The counts of one sorted range before each of its rows.  Only what later rows need is kept from batch to batch."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        fid, n, days, each = None, 0, np.zeros(0, "int64"), np.zeros(0, "int64")
        sums, codes = dict.fromkeys(counts[1:], 0), np.zeros(0, "int64")
        for b in batches:
            size = b.num_rows
            if not size:
                continue
            col = {c: b.column(c).to_numpy(zero_copy_only=False).astype("int64") for c in ("day", *counts[1:])}
            who, day = b.column("fid").to_numpy(zero_copy_only=False), col["day"]
            new = np.r_[who[0] != fid, who[1:] != who[:-1]]
            if new[0]:
                n, days, each, codes, sums = 0, days[:0], each[:0], codes[:0], dict.fromkeys(sums, 0)
            starts = np.flatnonzero(np.r_[True, new[1:]])
            run_no = np.cumsum(np.r_[True, new[1:]]) - 1
            begin = starts[run_no]
            first, ends = run_no == 0, np.flatnonzero(run_no == 0)[-1] + 1
            at = np.arange(size) - begin
            out = {"n_before": at + np.where(first, n, 0)}
            for c in counts[1:]:
                before = np.cumsum(col[c]) - col[c]
                out[f"{c}_before"] = before - before[begin] + np.where(first, sums[c], 0)
            code = np.where(col["won"] == 1, 1, np.where(col["lost"] == 1, 2, 3))
            # results and last day of the rows that came before stand in front
            held = len(codes)
            seen, place = np.r_[codes, code], np.arange(size) + held
            depth, tails = at + np.where(first, held, 0), np.zeros(size, "int64")
            for j in range(1, tail + 1):
                tails |= np.where(depth >= j, seen[np.maximum(place - j, 0)] << 2 * (j - 1), 0)
            out["tail"] = tails
            prior = np.r_[days[-1] if len(days) else 0, day[:-1]]
            out["gap"] = np.where(out["n_before"] > 0, day - prior, 0)
            span = int(day.max() - day.min()) + year + 2
            key = run_no * span + (day - day.min())
            low = np.maximum(np.searchsorted(key, key - year, "left"), begin)
            counted = np.searchsorted(key, key, "left") - low
            total = np.r_[0, np.cumsum(each)]
            mine = day[:ends]
            counted[:ends] += np.maximum(total[np.searchsorted(days, mine, "left")] - total[np.searchsorted(days, mine - year, "left")], 0)
            out["year_n"] = counted
            last = starts[-1]
            if last:
                n, days, each, codes, sums = 0, days[:0], each[:0], codes[:0], dict.fromkeys(sums, 0)
            fid, n, codes = who[-1], n + size - last, np.r_[codes, code[last:]][-tail:]
            sums = {c: sums[c] + int(col[c][last:].sum()) for c in sums}
            some, many = np.unique(day[last:], return_counts=True)
            if len(days) and days[-1] == some[0]:
                each[-1] += many[0]
                some, many = some[1:], many[1:]
            days, each = np.r_[days, some], np.r_[each, many]
            kept = days >= days[-1] - year
            days, each = days[kept], each[kept]
            added = [pa.array(out[c].astype("int32") if c in ("tail", "gap", "year_n") else out[c]) for c in out]
            added[list(out).index("gap")] = pa.array(out["gap"].astype("int32"), mask=(out["n_before"] == 0) | (prior == no_day))
            yield pa.RecordBatch.from_arrays([*b.columns, *added], names=[*b.schema.names, *out])

    return run


def ranged(sides: DataFrame, ranges: int | None = None) -> DataFrame:
    """``sides`` sorted by (fid, day, bout_id) in ranges (``_part``), each row with ``STATE`` as far as its own range tells.

    Write it before `carried`, which reads it more than once.  Rows without a day come before all others, those without an id first in
    their day; they count for later rows and get no record themselves.  Rows without a competitor are in no history.
    """
    extras = [c for c in sides.columns if c not in ("bout_id", "bout_date", "fid", *COUNTS)]
    rows = sides.select(
        "fid", F.coalesce(F.datediff("bout_date", F.lit(EPOCH).cast("date")), F.lit(NO_DAY)).alias("day"), "bout_id", *extras,
        *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS[1:]]).filter("fid IS NOT NULL")
    keys = [F.col(c) for c in ("fid", "day", "bout_id", *extras)]
    rows = (rows.repartitionByRange(ranges, *keys) if ranges else rows.repartitionByRange(*keys)).sortWithinPartitions(*keys)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + [f"{c} {'int' if c in ('tail', 'gap', 'year_n') else 'bigint'}" for c in STATE])
    return rows.mapInArrow(_counter(COUNTS, TAIL, YEAR, NO_DAY), schema).withColumn("_part", F.spark_partition_id())


def _joined_tails(ahead: Column, n: Column, own: Column) -> Column:
    """The last results of ``ahead`` and then ``own``, which holds ``n`` of them."""
    bits = F.least(n, F.lit(TAIL)).cast("int") * 2
    moved = F.when(bits == 0, ahead)
    for k in range(1, TAIL):
        moved = moved.when(bits == 2 * k, F.shiftleft(ahead, 2 * k))
    return F.coalesce(moved, F.lit(0)).bitwiseOR(own).bitwiseAND(4**TAIL - 1)


def _carries(rows: DataFrame) -> DataFrame:
    """One row for each range whose first competitor began in an earlier one: (fid, _part) and ``_c_`` columns."""
    code = F.when(F.col("won") == 1, 1).when(F.col("lost") == 1, 2).otherwise(3)
    own = F.shiftleft("tail", 2).bitwiseOR(code).bitwiseAND(4**TAIL - 1)
    runs = rows.groupBy("fid", "_part").agg(
        F.count("*").alias("n"), *[F.sum(c).alias(c) for c in COUNTS[1:]], F.min("day").alias("first"), F.max("day").alias("last"),
        F.max(F.shiftleft("n_before", 2 * TAIL).bitwiseOR(own)).bitwiseAND(4**TAIL - 1).cast("int").alias("own"))
    earlier = Window.partitionBy("fid").orderBy("_part")
    before = earlier.rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumns({
        "_runs": F.count("*").over(Window.partitionBy("fid")), **{f"_c_{c}": F.sum(c).over(before) for c in COUNTS},
        "_c_last": F.max("last").over(before), "_tails": F.collect_list(F.struct("n", "own")).over(earlier.rowsBetween(-TAIL, -1))})
    runs = runs.filter("_runs > 1").withColumn("_c_tail", F.aggregate("_tails", F.lit(0), lambda t, r: _joined_tails(t, r["n"], r["own"])))
    # days of competitors in more than one range; there are fewer of these than twice the ranges
    days = rows.join(F.broadcast(runs.select("fid").distinct()), "fid", "left_semi").groupBy("fid", "_part", "day").agg(F.count("*").alias("k"))
    same_day = Window.partitionBy("fid", "day").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    opened = days.withColumn("_same", F.sum("k").over(same_day)).select("fid", "_part", F.col("day").alias("first"), "_same")
    whole = days.groupBy(F.col("fid").alias("_f"), F.col("day").alias("_day")).agg(F.sum("k").alias("k"))
    keep = [c for c in runs.columns if c.startswith("_c_")]
    runs = runs.filter("_c_n IS NOT NULL").select("fid", "_part", "first", *keep)
    near = runs.select("fid", "_part", "first").join(whole, (F.col("fid") == F.col("_f")) & (F.col("_day") < F.col("first")) & (F.col("_day") >= F.col("first") - YEAR))
    near = near.select("fid", "_part", "_day", "k").unionByName(
        runs.select("fid", "_part", "first").join(opened, ["fid", "_part", "first"]).filter("_same IS NOT NULL").select("fid", "_part", F.col("first").alias("_day"), F.col("_same").alias("k")))
    near = near.groupBy("fid", "_part").agg(F.collect_list(F.struct("_day", "k")).alias("_near"))
    out = runs.join(near, ["fid", "_part"], "left").withColumn("_near", F.coalesce("_near", F.array().cast("array<struct<_day:int,k:bigint>>")))
    # rows of earlier ranges in the year before the first day of the run here, the day after it, and so on
    year = F.transform(F.sequence(F.lit(0), F.lit(YEAR)), lambda j: F.aggregate(
        F.filter("_near", lambda x: (x["_day"] >= F.col("first") + j - YEAR) & (x["_day"] < F.col("first") + j)), F.lit(0).cast("bigint"), lambda t, x: t + x["k"]).cast("int"))
    return out.withColumn("_c_year", year).withColumnRenamed("first", "_c_first").drop("_near")


def carried(rows: DataFrame) -> DataFrame:
    """Written rows of `ranged` with ``STATE`` over the whole history, and bout_date.  At most one small carry a range is broadcast."""
    out = rows.filter((F.col("day") > NO_DAY) & F.col("bout_id").isNotNull()).join(F.broadcast(_carries(rows)), ["fid", "_part"], "left")
    year = F.get(F.col("_c_year"), F.col("day") - F.col("_c_first"))
    state = {f"{c}_before": F.col(f"{c}_before") + F.coalesce(f"_c_{c}", F.lit(0)) for c in COUNTS}
    state["tail"] = F.when(F.col("_c_n").isNull(), F.col("tail")).otherwise(_joined_tails(F.col("_c_tail"), F.col("n_before"), F.col("tail")))
    state["gap"] = F.coalesce("gap", F.when(F.col("_c_last") > NO_DAY, F.col("day") - F.col("_c_last")))
    state["year_n"] = F.col("year_n") + F.coalesce(year, F.lit(0))
    out = out.withColumns(state).withColumn("bout_date", F.date_add(F.lit(EPOCH).cast("date"), F.col("day")))
    return out.select(*[c for c in rows.columns if c not in ("day", "_part")], "bout_date")


def record(get: Callable[[str], Column]) -> dict[str, Column]:
    """recent_wins, form, wins, losses, exp, months_off, days_off, fights_12m, fin_rate, sub_rate and bouts_before from ``STATE``."""
    places = [F.shiftright(get("tail"), 2 * j).bitwiseAND(3) for j in reversed(range(TAIL))]
    letters = [F.when(p == 1, LETTERS[1]).when(p == 2, LETTERS[2]).when(p == 3, LETTERS[3]).otherwise("") for p in places]
    wins, losses, gap = get("won_before"), get("lost_before"), get("gap")
    return {
        "recent_wins": sum(((p == 1).cast("int") for p in places[1:]), (places[0] == 1).cast("int")), "form": F.concat(*letters),
        "wins": wins.cast("int"), "losses": losses.cast("int"),
        "exp": (wins + losses).cast("int"), "bouts_before": get("n_before").cast("int"),
        "days_off": F.coalesce(gap, F.lit(-1)), "months_off": F.floor(F.coalesce(gap, F.lit(0)) / 30).cast("int"),
        "fights_12m": get("year_n").cast("int"),
        "fin_rate": F.when(wins > 0, get("fin_before") / wins).otherwise(F.lit(0.5)),
        "sub_rate": F.when(wins > 0, get("sub_before") / wins).otherwise(F.lit(0.0))}


def point_in_time(sides: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """Record before each bout.  ``sides``: bout_id, bout_date, fid, won, lost, fin, sub, plus any others.

    Order is (bout_date, bout_id).  Adds recent_wins, form, wins, losses, exp,
    months_off, days_off, fights_12m, fin_rate and sub_rate.  Ranges have about 2**``bits`` rows.
    """
    rows = materialize(ranged(sides, math.ceil(max(sides.count(), 1) / 2**bits)), "history-ranges")
    return carried(rows).withColumns(record(F.col)).drop(*STATE)


def global_position(df: DataFrame, day: str, ident: str, name: str = "seq", bits: int = BLOCK_BITS) -> DataFrame:
    """1-based position in the total order (day, id) of the whole table.

    Counted at the same three levels.  Only the day level, one row per calendar day,
    is ordered without partitioning.
    """
    keyed = df.withColumns({
        "_d": F.datediff(F.col(day), F.lit("1970-01-01").cast("date")), "_b": F.shiftright(ident, bits)})
    blocks = keyed.groupBy("_d", "_b").agg(F.count("*").alias("_n"))
    before_block = Window.partitionBy("_d").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before_day = Window.orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)
    days = blocks.groupBy("_d").agg(F.sum("_n").alias("_dn"))
    days = days.select("_d", F.coalesce(F.sum("_dn").over(before_day), F.lit(0)).alias("_day_start"))
    starts = blocks.select("_d", "_b", F.coalesce(F.sum("_n").over(before_block), F.lit(0)).alias("_blk_start"))
    starts = starts.join(days, "_d")
    within = F.row_number().over(Window.partitionBy("_d", "_b").orderBy(ident))
    placed = keyed.withColumn("_r", within).join(starts, ["_d", "_b"])
    return placed.withColumn(name, F.col("_r") + F.col("_blk_start") + F.col("_day_start")).drop(
        "_d", "_b", "_r", "_blk_start", "_day_start")


def latest(df: DataFrame, k: int, day: str = "bout_date", ident: str = "bout_id") -> DataFrame:
    """The last ``k`` rows with ``from_end`` = 1 for the last one.

    A top-k per partition, then a window over those ``k`` rows only.
    """
    top = df.orderBy(F.col(day).desc(), F.col(ident).desc()).limit(k)
    return top.withColumn("from_end", F.row_number().over(Window.orderBy(F.col(day).desc(), F.col(ident).desc())))
