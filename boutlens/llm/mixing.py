"""Mixing sources to target weights by entropy balancing.

The mix is the distribution of words nearest to the corpus, in relative entropy of word mass, whose words per source meet
the targets.  Its dual is convex with one multiplier per source; a document is taken at the rate
``exp(multiplier)``, at most ``cap``.  Newton steps on the dual read only the words per (source, size), summed by Spark.

Rates become whole copies: within a source, sizes are walked from large to small and each size gets the copies that bring
the running total nearest to the running target, so the last error is about half the smallest document.  Inside one
(source, size) the documents with the smallest hashes get the odd copies; their ranks are counted in blocks, so that one
source or size with a third of all rows never meets in one task.

Defined cases: null texts and texts without words have size 0 and take 0 words; a null source is a source of its own and comes last
in the order of weights; repeated rows are separate rows, but
those with one doc_id and text have one hash, and so all meet in one block; very long texts are counted in their row; an empty table gives no rows; columns
named like the results are replaced, all others, whatever their names, come back as they were; results depend on no partitioning.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boutlens.llm.columns import set_aside
from boutlens.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_ROWS = 4096
STEPS, NEAR = 40, 1e-9
RESULT = ("size", "source_size", "target", "copies", "taken")


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn("size", F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")).withColumn(
        "_s", F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source"))))


def targets(by_source: DataFrame, cap: float = 3.0, cycle: int = 3) -> DataFrame:
    """``by_source`` (source, source_size, one row per source) with weight and target.

    Weights run 1, 2, .., cycle over the sources by code point, null last.  The total is shared by weight; what exceeds ``cap`` times a
    source's size is shared again among the others.  That ends at one level per weight: sources in the order of
    cap / weight stop at their cap until the level of the rest lies below the next.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    rows = by_source.withColumn("weight", (place - 1) % cycle + 1)
    order = Window.orderBy("_full", F.col("source").asc_nulls_last())
    rows = rows.withColumn("_full", cap * F.col("source_size") / F.col("weight"))
    rows = rows.withColumn("_left", F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum(cap * F.col("source_size")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    rows = rows.withColumn("_level", F.col("_left") / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    rows = rows.withColumn("_at", F.min(F.when(F.col("_full") >= F.col("_level"), F.struct("_full", "_level"))).over(Window.partitionBy()))
    level = F.coalesce(F.col("weight") * F.col("_at._level"), F.lit(float("inf")))
    return rows.withColumn("target", F.least(cap * F.col("source_size"), level)).drop("_full", "_left", "_level", "_at")


def multipliers(classes: DataFrame, goal: DataFrame, cap: float = 3.0) -> DataFrame:
    """(_s, rate): Newton on the dual, started at the corpus itself, for all sources at once.

    The dual of source s is mass * exp(m) - target * m.  A step never moves m by more than one, which keeps the first steps of a
    far target inside the region where Newton converges.
    """
    now = materialize(goal.select("_s", "target", F.lit(0.0).alias("m")), "mixing-0")
    mass = materialize(classes.groupBy("_s").agg(F.sum(F.col("size") * F.col("n")).alias("mass")), "mixing-mass")
    for step in range(1, STEPS + 1):
        words = F.col("mass") * F.exp("m")
        move = F.when((F.col("mass") > 0) & (F.col("target") > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("target") / words - 1))).otherwise(0.0)
        now = materialize(now.drop("mass", "move").join(mass, "_s").withColumn("move", move).withColumn("m", F.col("m") + F.col("move")), f"mixing-{step}")
        if (now.agg(F.max(F.abs("move"))).first()[0] or 0.0) < NEAR:
            break
    return now.select("_s", F.when((F.col("mass") > 0) & (F.col("target") > 0), F.least(F.lit(cap), F.exp("m"))).otherwise(0.0).alias("rate"))


def _copies(cap: float):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        """Copies of each size of one source; its rows are distinct sizes."""
        frame = frame.sort_values("size", ascending=False, ignore_index=True)
        goal = taken = 0.0
        out = []
        for size, n, rate in zip(frame["size"].tolist(), frame["n"].tolist(), frame["rate"].tolist(), strict=True):
            goal += size * n * rate
            c = int(min(cap * n, max(0, round((goal - taken) / size)))) if size else int(round(n * rate))
            taken += c * size
            out.append(c)
        frame["copies_all"] = np.array(out, np.int64)
        return frame[["_s", "size", "n", "copies_all"]]
    return run


def mix(docs: DataFrame, cap: float = 3.0, text: str = "text") -> DataFrame:
    """``docs``, all rows and columns, with size, source_size, target, copies and taken."""
    docs, own = set_aside(docs, ("doc_id", "source", text), RESULT)
    rows = sized(docs, text).withColumn("_h", F.xxhash64("doc_id", text))
    classes = materialize(rows.groupBy("_s", "size").agg(F.count("*").alias("n"), F.first("source").alias("source")), "mixing-classes")
    by_source = classes.groupBy("_s").agg(F.first("source").alias("source"), F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goal = materialize(targets(by_source, cap), "mixing-targets")
    rates = multipliers(classes, goal, cap)
    plan = classes.select("_s", "size", "n").join(rates, "_s").groupBy("_s").applyInPandas(_copies(cap), "_s string, size long, n long, copies_all long")
    plan = plan.join(goal.select("_s", "source_size", "target"), "_s")
    plan = materialize(plan.withColumn("_blocks", F.ceil(F.col("n") / BLOCK_ROWS)), "mixing-plan")

    dealt = rows.join(plan, ["_s", "size"]).withColumn("_block", F.pmod(F.col("_h"), F.col("_blocks")))
    counts = rows.select("_s", "size", "_h").join(plan.where("_blocks > 1").select("_s", "size", "_blocks"), ["_s", "size"]).groupBy("_s", "size", F.pmod(F.col("_h"), F.col("_blocks")).alias("_block")).agg(F.count("*").alias("_in"))
    before = F.sum("_in").over(Window.partitionBy("_s", "size").orderBy("_block")) - F.col("_in")
    counts = materialize(counts.select("_s", "size", "_block", before.alias("_before")), "mixing-blocks")
    rank = F.row_number().over(Window.partitionBy("_s", "size", "_block").orderBy("_h", "doc_id"))
    ranked = dealt.withColumn("_rank", rank).join(counts, ["_s", "size", "_block"], "left")
    odd = F.coalesce("_before", F.lit(0)) + F.col("_rank") <= F.col("copies_all") % F.col("n")
    ranked = ranked.withColumn("copies", (F.floor(F.col("copies_all") / F.col("n")) + odd.cast("long")).cast("long"))
    ranked = ranked.withColumn("taken", F.col("copies") * F.col("size"))
    return ranked.select(*own, *RESULT)
