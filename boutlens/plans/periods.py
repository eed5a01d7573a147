"""Training over a period: every bout is scored before it is trained on.

The bouts of a period come in batches of a fixed size, in order of date and id.  A full batch trains the model that the next batch
of the same period is scored with; the rest of a period that fills no batch trains nothing.  Periods start from the same
stored model and are chains of their own.  Batch k needs the weights of batch k - 1, so a chain is worked off in one task, and chains
side by side; a task reads its rows in order and holds one batch at a time, however long the period is.

A training batch is the new rows, at full weight, and some older rows, drawn from all bouts before the latest ``window``.  The draw is
by position, so it costs as many rows as it takes, however long the history is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutlens import constants as K
from boutlens.functions.numbers import confidence_factor
from boutlens.operators import models as M
from boutlens.operators import scoring as S
from boutlens.operators.history import global_position
from boutlens.plans.training import descend, keep_masks
from boutlens.session import materialize

#: histories up to this many rows are drawn from by sorting, longer ones by repeated draws
SORTED, DRAWS = 1024, 240
#: batches whose older rows one task draws
TOGETHER = 256


def ticket(text: str) -> int:
    """52 random bits of a text."""
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16)


def draw(text: str, h: int, older: int) -> list[int]:
    """The ``older`` positions from 1 to ``h`` that a batch draws; ``text`` names the seed, the period and the batch."""
    if h <= SORTED:
        return sorted(range(1, h + 1), key=lambda i: (ticket(f"{text}|{i}"), i))[:older]
    drawn: dict[int, None] = {}
    for i in range(max(DRAWS, 4 * older)):
        if len(drawn) >= older:
            break
        drawn[ticket(f"{text}|{i}") % h + 1] = None
    return list(drawn)


def in_batches(features: DataFrame, size: int, period: Column) -> tuple[DataFrame, DataFrame]:
    """Rows with seq, period and batch; and (period, start, n), one row per period."""
    rows = materialize(global_position(features, "bout_date", "bout_id").withColumn("period", period), "periods-rows")
    starts = materialize(rows.groupBy("period").agg(F.min("seq").alias("start"), F.count("*").alias("n")), "periods-starts")
    rows = rows.join(starts, "period").withColumn("batch", F.expr(f"(seq - start) div {size}"))
    return rows, starts


def older_rows(starts: DataFrame, size: int, window: int, older: int, seed: int) -> DataFrame:
    """(period, batch, seq): the positions that each full batch draws from the bouts before its window.

    The draws of a batch are a small loop over plain numbers: as an array expression Spark works the whole list of hashes out again for
    every element that it takes from it.  Batches are spread by their number, since their rows are few and narrow.
    """
    full = starts.filter(F.col("n") >= size).select("period", "start", F.explode(F.expr(f"sequence(0, n div {size} - 1)")).alias("batch"))
    full = full.withColumn("h", F.col("start") - 1 + size * (F.col("batch") + 1) - window).filter("h > 0")
    full = full.select("period", "batch", F.col("h").cast("long").alias("h"), F.concat_ws("|", F.lit(str(seed)), F.col("period"), F.col("batch").cast("string")).alias("text"))
    batches = starts.agg(F.sum(F.expr(f"n div {size}"))).first()[0] or 0

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            at = [draw(text, h, older) for text, h in zip(part["text"], part["h"], strict=True)]
            yield part[["period", "batch"]].assign(seq=at).explode("seq").dropna(subset=["seq"]).astype({"seq": "int64"})

    spread = full.repartition(batches // TOGETHER + 1, "period", "batch")
    kinds = {f.name: f.dataType.simpleString() for f in full.schema}
    return spread.mapInPandas(run, f"period {kinds['period']}, batch {kinds['batch']}, seq bigint")


def training_rows(rows: DataFrame, starts: DataFrame, size: int, window: int, older: int, seed: int) -> DataFrame:
    """The rows of all full batches with label and sample weight."""
    factor = confidence_factor(F.when(F.col("blind_pick").isNotNull(), F.col("blind_conf")))
    label = F.coalesce((F.col("winner_side") == "a").cast("int"), F.lit(0))

    def batch(df: DataFrame, new: bool) -> DataFrame:
        return df.select("period", "batch", label.alias("label"), S.sample_weight(F.lit(new), factor).alias("sample_weight"), *K.FEATURE_NAMES)

    fresh = rows.filter(F.expr(f"batch < n div {size}"))
    drawn = older_rows(starts, size, window, older, seed).join(rows.drop("period", "batch", "start", "n"), "seq")
    return batch(fresh, True).unionByName(batch(drawn, False))


def folded(models: DataFrame) -> DataFrame:
    """(period, batch, coef, intercept): the scaling folded into the weights, so that a row is scored by 46 products."""
    coef, shift = [], F.col("bias")
    for j in range(K.WIDTH):
        w, m, s = (F.get(c, F.lit(j)) for c in ("weights", "means", "stds"))
        c = w if j in K.UNSCALED else w / F.when(s <= 1e-12, F.lit(1.0)).otherwise(s)
        coef.append(c)
        shift = shift if j in K.UNSCALED else shift - c * m
    return models.select("period", "batch", F.array(*coef).alias("coef"), shift.alias("intercept"))


def chains(epochs: int, seed: int):
    """For rows ordered by (period, batch), with the start of every chain beside them: the weights after each batch, as batch + 1."""
    keep = keep_masks(epochs, seed)

    def trained(rows: pd.DataFrame, w: np.ndarray, b: float) -> tuple[np.ndarray, float]:
        # a fixed order of the rows fixes the order of the sums
        rows = rows.sort_values([*K.FEATURE_NAMES, "label", "sample_weight"])
        new, bias, _ = descend(rows[K.FEATURE_NAMES].to_numpy(float), rows["label"].to_numpy(float), rows["sample_weight"].to_numpy(float), w, b, keep)
        return M.settled(w, new, np.array(rows["stds"].iloc[0], float), bias)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest, chain, w, b = None, None, None, 0.0

        def step(rows: pd.DataFrame) -> pd.DataFrame:
            nonlocal chain, w, b
            period, batch = rows["period"].iloc[0], int(rows["batch"].iloc[0])
            if chain is None or period != chain[0]:
                chain, w, b = (period,), np.array(rows["weights"].iloc[0], float), float(rows["bias"].iloc[0])
            w, b = trained(rows, w, b)
            return pd.DataFrame({"period": [period], "batch": [batch + 1], "weights": [w.tolist()], "bias": [b]})

        for part in parts:
            part = part if rest is None else pd.concat([rest, part], ignore_index=True)
            if not len(part):
                continue
            new = (part["period"] != part["period"].shift()) | (part["batch"] != part["batch"].shift())
            edges = np.flatnonzero(new.to_numpy())
            # the last batch of a part may go on in the next one
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                yield step(part.iloc[i:j])
            rest = part.iloc[edges[-1]:]
        if rest is not None and len(rest):
            yield step(rest)

    return run


def train_periods(features: DataFrame, model: DataFrame, period: Column | None = None, size: int = K.BATCH_TRAIN_SIZE, window: int = K.RECENT_WINDOW,
                  older: int = K.HISTORICAL_TARGET, epochs: int = K.EPOCHS, seed: int = K.TRAIN_SEED) -> tuple[DataFrame, DataFrame]:
    """Rows with ``proba_a`` from the weights of their own time, and the table (period, batch, weights, bias, means, stds) of these weights.

    ``model`` is one row (weights, bias, means, stds), ``period`` defaults to the month of ``bout_date``.
    """
    period = F.date_format("bout_date", "yyyy-MM") if period is None else period
    rows, starts = in_batches(features, size, period)
    first = materialize(model.select("weights", "bias", "means", "stds"), "periods-model")
    start = first.select(F.struct("weights", "bias", "means", "stds").alias("m")).scalar()
    train = training_rows(rows, starts, size, window, older, seed).select("period", "batch", "label", "sample_weight", *K.FEATURE_NAMES)
    # two partitions a period, so that few periods share a task
    train = train.repartition(2 * max(starts.count(), 1), "period").sortWithinPartitions("period", "batch").withColumn("_m", start)
    after = train.select("period", "batch", "label", "sample_weight", *K.FEATURE_NAMES, "_m.weights", "_m.bias", "_m.stds").mapInPandas(
        chains(epochs, seed), f"period {rows.schema['period'].dataType.simpleString()}, batch int, weights array<double>, bias double")
    after = after.withColumn("_m", start).select("period", "batch", "weights", "bias", "_m.means", "_m.stds")
    begun = starts.withColumn("_m", start).select("period", F.lit(0).alias("batch"), "_m.weights", "_m.bias", "_m.means", "_m.stds")
    models = materialize(begun.unionByName(after), "periods-models")
    scored = rows.join(materialize(folded(models), "periods-folded"), ["period", "batch"])
    z = S.linear([F.col(n) for n in K.FEATURE_NAMES], [F.get("coef", F.lit(j)) for j in range(K.WIDTH)], F.col("intercept"))
    return scored.withColumn("proba_a", S.sigmoid(z)).drop("coef", "intercept"), models
