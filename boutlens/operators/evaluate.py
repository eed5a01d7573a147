"""Evaluation: hit rates by slice, confidence, session, period and card."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rate(hits: Column, total: Column) -> Column:
    """Percent, 0 when there is nothing to divide by."""
    return F.when(total > 0, hits * 100.0 / total).otherwise(F.lit(0.0))


def hit_counts(df: DataFrame, by: list[str], correct: str = "correct") -> DataFrame:
    """Totals, hits, misses and accuracy per group; combined before the shuffle."""
    g = df.groupBy(*by).agg(F.count("*").alias("total"), F.sum(correct).alias("hits"))
    return g.withColumns({"misses": F.col("total") - F.col("hits"), "accuracy": rate(F.col("hits"), F.col("total"))})


def confidence_buckets(df: DataFrame, proba: str = "proba_a", edge: float = 0.60) -> DataFrame:
    """Accuracy of all, confident and unsure rows: one rollup, one pass."""
    sure = F.greatest(F.col(proba), 1.0 - F.col(proba))
    g = df.withColumn("bucket", F.when(sure >= edge, "confident").otherwise("unsure")).rollup("bucket").agg(
        F.count("*").alias("total"), F.sum("correct").alias("hits"))
    return g.select(F.coalesce("bucket", F.lit("all")).alias("bucket"), "total", "hits", rate(F.col("hits"), F.col("total")).alias("accuracy"))


def session_summary(df: DataFrame) -> DataFrame:
    """One row: totals, accuracy, and how often the blind pick answered and was right.

    Undecided bouts count as errors and are left out of the accuracy.
    """
    decided = F.col("winner").isNotNull()
    pick = F.when(F.col("blind_pick") == "X", F.col("fighter_a")).when(F.col("blind_pick") == "Y", F.col("fighter_b"))
    answered = decided & pick.isNotNull()
    g = df.agg(
        F.count("*").alias("total"), F.count_if(decided & (F.col("pred_winner") == F.col("winner"))).alias("correct"),
        F.count_if(decided & (F.col("pred_winner") != F.col("winner"))).alias("incorrect"), F.count_if(~decided).alias("errors"),
        F.count_if(answered).alias("answered"), F.count_if(answered & (pick == F.col("winner"))).alias("agree"))
    return g.withColumns({"accuracy": rate(F.col("correct"), F.col("correct") + F.col("incorrect")),
                          "blind_accuracy": rate(F.col("agree"), F.col("answered"))})


def prequential(df: DataFrame, batch_size: int) -> DataFrame:
    """Per month: accuracy of the predictions made before training, and batches triggered so far.

    Months are few, so the running total is a window over one row per month.
    """
    from pyspark.sql import Window
    g = hit_counts(df.withColumn("month", F.date_format("bout_date", "yyyy-MM")), ["month"])
    running = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    return g.withColumn("batches_done", F.floor(F.sum("total").over(running) / batch_size))


def wrong_predictions(df: DataFrame) -> DataFrame:
    """Every decided bout whose predicted winner is not the winner: a table, of which a caller may show any part.

    The outer generator keeps the filter above the prediction.  Pushed below it, the filter would hold the whole score, written out
    again wherever the prediction names it, and be worked out beside the columns.
    """
    row = F.struct("bout_id", "bout_date", "fighter_a", "fighter_b", F.col("pred_winner").alias("predicted"), F.col("winner").alias("fact"))
    return df.select(F.inline_outer(F.array(row))).filter(F.col("fact").isNotNull() & (F.col("predicted") != F.col("fact")))


def batch_composition(batch: DataFrame, plain_fresh: float, plain_old: float) -> DataFrame:
    """One row: fresh, historical and up-weighted rows of a training batch.

    Up-weighted rows weigh more than their stratum does without the confidence factor.
    """
    base = F.when(F.col("is_fresh") == 1, F.lit(plain_fresh)).otherwise(F.lit(plain_old))
    return batch.agg(F.count("*").alias("total"), F.count_if(F.col("is_fresh") == 1).alias("fresh"), F.count_if(F.col("is_fresh") == 0).alias("historical"),
                     F.count_if(F.col("sample_weight") > base + 1e-9).alias("up_weighted"))
