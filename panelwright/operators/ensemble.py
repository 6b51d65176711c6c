"""Weighted ensembles of fold models and the signals they give."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import as_list, ordered, whole
from .signals import TIERS, confidence, tier_size

# Recency share, smallest accuracy margin, filters and the full-confidence move.
RECENCY, MARGIN, MIN_DA, MIN_IC, FULL_MOVE = 0.4, 0.01, 0.40, -0.15, 0.05


def ensemble_weights(
    folds: DataFrame, by: Sequence[str] = ("symbol",), fold: str = "fold", recency: float = RECENCY,
    min_da: float = MIN_DA, min_ic: float = MIN_IC,
) -> DataFrame:
    """Accuracy margin blended with an exponential taper towards recent folds.

    Weak folds are left out first; the taper runs evenly from e^0 to e^2 over the folds that remain.
    """
    by = as_list(by)
    kept = folds.filter((F.col("dir_acc") >= min_da) & (F.col("ic") >= min_ic))
    all_, w = whole(by), ordered(by, fold)
    kept = kept.withColumns(
        {
            "__acc": F.greatest(F.col("dir_acc") - 0.5, F.lit(MARGIN)),
            "__rec": F.exp(F.coalesce(F.try_divide(2.0 * (F.row_number().over(w) - 1), F.count(F.lit(1)).over(all_) - 1), F.lit(0.0))),
        }
    )
    mix = (1 - recency) * F.col("__acc") / F.sum("__acc").over(all_) + recency * F.col("__rec") / F.sum("__rec").over(all_)
    kept = kept.withColumn("__mix", mix)
    return kept.withColumn("weight", F.col("__mix") / F.sum("__mix").over(all_)).drop("__acc", "__rec", "__mix")


def ensemble(
    fold_preds: DataFrame, weights: DataFrame, by: Sequence[str] = ("symbol",), date: str = "date", fold: str = "fold"
) -> DataFrame:
    """Weighted mean forecast, agreement of signs, direction, percent move and confidence per day.

    The sign of the mean is unknown until every fold is summed, so the counts of both signs travel through
    the one aggregation and the matching one is picked afterwards.
    """
    by = as_list(by)
    joined = fold_preds.join(weights.select(*by, fold, "weight"), [*by, fold])
    p = F.col("pred")
    sums = joined.groupBy(*by, date).agg(
        F.sum(F.col("weight") * p).alias("ensemble"), F.count(F.lit(1)).alias("n_folds"),
        F.count_if(p > 0).alias("__up"), F.count_if(p < 0).alias("__down"), F.count_if(p == 0).alias("__zero"),
    )
    e = F.col("ensemble")
    same = F.when(e > 0, F.col("__up")).when(e < 0, F.col("__down")).otherwise(F.col("__zero"))
    return sums.withColumns(
        {
            "agreement": same / F.col("n_folds"),
            "direction": F.when(e > 0, "BULLISH").otherwise("BEARISH"),
            "pct_ret": (F.exp(e) - 1) * 100,
            "confidence": F.least(F.abs(e) / FULL_MOVE, F.lit(1.0)),
        }
    ).drop("__up", "__down", "__zero")


def recent_signals(
    ensembles: DataFrame, n: int = 60, min_signal: float = 0.008, max_pos: float = 1.0, tiers=TIERS,
    by: Sequence[str] = ("symbol",), date: str = "date",
) -> DataFrame:
    """The last ``n`` signals per key, confidence recalibrated on that batch, size re-applied."""
    by = as_list(by)
    newest = Window.partitionBy(*by).orderBy(F.col(date).desc())
    batch = ensembles.withColumn("__rn", F.row_number().over(newest)).filter(F.col("__rn") <= n).drop("__rn")
    batch = confidence(batch, "batch", by, "ensemble", date)
    size = tier_size("conf_pct", tiers)
    long = (F.abs("ensemble") >= min_signal) & (F.col("ensemble") > 0)
    return batch.withColumn("position", F.when(long, size * max_pos).otherwise(0.0))
