"""Forecasts to positions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import as_list, avg_rank, col, dealt, ordered, whole
from .order_stats import rank_so_far

BY = ("strategy", "symbol")

# Confidence tiers (from, below, size).
TIERS = ((0.0, 0.25, 0.25), (0.25, 0.5, 0.5), (0.5, 0.75, 0.75), (0.75, 1.01, 1.0))

# Yearly yield of the cash-and-bonds mode.
BOND_YIELD = 0.04

# Names of the two actions and of their reasons.
ACTIONS, REASONS = ("BUY", "HOLD CASH"), ("signal below minimum threshold", "confidence and agreement")

LONG_ONLY_MODES = ("long_only", "cash_long", "cash_bonds")


def confidence(
    df: DataFrame, mode: str = "whole", by: Sequence[str] = BY, pred: str = "pred", date: str = "date",
    window: int = 252, name: str = "conf_pct",
) -> DataFrame:
    """Percentile of |pred| within its key (G1).

    ``whole``     average-tie rank over the whole history (looks ahead; the parity mode)
    ``batch``     share of the key's rows that are strictly smaller
    ``trailing``  average-tie rank among the last ``window`` rows
    ``expanding`` average-tie rank among all rows so far
    """
    by = as_list(by)
    df = df.withColumn("__abs", F.abs(col(pred)))
    size = F.count("__abs").over(whole(by))
    if mode == "whole":
        conf = avg_rank(by, "__abs") / size
    elif mode == "batch":
        conf = (F.rank().over(ordered(by, "__abs")) - 1) / size
    elif mode in ("trailing", "expanding"):
        return rank_so_far(df, {name: "__abs"}, window if mode == "trailing" else None, by=by, order=date).drop("__abs")
    else:
        raise ValueError(f"unknown confidence mode {mode!r}")
    return df.withColumn(name, conf).drop("__abs")


def confidence_against(
    df: DataFrame, reference: DataFrame, by: Sequence[str] = BY, pred: str = "pred", name: str = "conf_pct",
    default: float = 0.5, ref_pred: str = "pred", partitions: int | None = None,
) -> DataFrame:
    """Share of the reference's |pred| that is strictly smaller, ``default`` without a reference (G1).

    Both sets are counted along one sort by value, in ``partitions`` tasks; nothing is compared pairwise.
    """
    by = as_list(by)
    ask = df.select(*by, F.abs(col(pred)).alias("__v")).distinct().withColumn("__ref", F.lit(0))
    ref = reference.select(*by, F.abs(col(ref_pred)).alias("__v")).groupBy(*by, "__v").agg(F.count(F.lit(1)).alias("__ref"))
    along = ordered(by, "__v")
    both = ask.withColumn("__ask", F.lit(True)).unionByName(ref.withColumn("__ask", F.lit(False)))
    both = dealt(both, partitions, by)
    both = both.groupBy(*by, "__v").agg(F.sum("__ref").alias("__ref"), F.max("__ask").alias("__ask"))
    smaller = F.sum("__ref").over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__ref")
    total = F.sum("__ref").over(whole(by))
    conf = both.withColumn("__conf", F.try_divide(smaller, total)).filter("__ask").select(*by, "__v", "__conf")
    joined = df.withColumn("__v", F.abs(col(pred))).join(conf, [*by, "__v"], "left")
    return joined.withColumn(name, F.coalesce("__conf", F.lit(default))).drop("__v", "__conf")


def tier_size(conf, tiers: Sequence[tuple[float, float, float]] = TIERS) -> Column:
    """Size of the tier [from, below) that holds the confidence, 0 outside all of them."""
    conf = col(conf)
    out = None
    for lo, hi, size in tiers:
        inside = (conf >= lo) & (conf < hi)
        out = F.when(inside, F.lit(float(size))) if out is None else out.when(inside, F.lit(float(size)))
    return out.otherwise(F.lit(0.0))


def direction(pred, min_signal) -> Column:
    """-1, 0 or 1 with a dead band."""
    pred = col(pred)
    return F.when(F.abs(pred) < min_signal, 0).otherwise(F.signum(pred).cast("int"))


def mode_direction(raw, mode) -> Column:
    """Shorts become flat in the long-only modes."""
    raw, mode = col(raw), mode if isinstance(mode, Column) else F.lit(mode)
    return F.when(mode.isin(*LONG_ONLY_MODES) & (raw < 0), 0).otherwise(raw)


def build_signals(
    df: DataFrame,
    min_signal=0.008,
    mode="cash_long",
    max_pos=1.0,
    tiers: Sequence[tuple[float, float, float]] = TIERS,
    conf_mode: str | None = "whole",
    by: Sequence[str] = BY,
) -> DataFrame:
    """Confidence, direction, size and position per forecast.

    ``min_signal``, ``mode`` and ``max_pos`` may be columns, which is how a sweep passes its parameters.
    """
    if conf_mode is not None:
        df = confidence(df, conf_mode, by)
    df = df.withColumn("raw_direction", direction("pred", min_signal))
    df = df.withColumn("direction", mode_direction("raw_direction", mode))
    df = df.withColumn("size_frac", F.when(F.col("direction") == 0, 0.0).otherwise(tier_size("conf_pct", tiers)))
    limit = max_pos if isinstance(max_pos, Column) else F.lit(float(max_pos))
    return df.withColumn("position", F.col("direction") * F.col("size_frac") * limit)


def exec_lag(df: DataFrame, k: int = 1, by: Sequence[str] = BY, actual: str = "actual", date: str = "date") -> DataFrame:
    """Realised return of the day the order can fill, ``k`` rows later; the tail without one is dropped."""
    if k == 0:
        return df
    return df.withColumn(actual, F.lead(actual, k).over(ordered(by, date))).filter(F.col(actual).isNotNull())


# Realised volatility, in percent, under which a warning is raised.
LOW_VOL_PCT = 12.0


def decide(
    df: DataFrame, min_signal: float = 0.008, max_pos: float = 1.0, tiers=TIERS, low_vol: float = LOW_VOL_PCT
) -> DataFrame:
    """Trade decision from ``ensemble, agreement, conf_pct, realised_vol`` rows."""
    signal = F.col("ensemble")
    quiet = F.abs(signal) < min_signal
    size = tier_size("conf_pct", tiers)
    buy = ~quiet & (signal > 0)
    return df.withColumns(
        {
            "size_frac": F.when(quiet, 0.0).otherwise(size),
            "position": F.when(buy, size * max_pos).otherwise(0.0),
            "action": F.when(buy, ACTIONS[0]).otherwise(ACTIONS[1]),
            "reason": F.when(quiet, REASONS[0]).otherwise(REASONS[1]),
            "vol_warning": F.col("realised_vol") < low_vol,
        }
    )


def conviction(agreement, conf) -> Column:
    """Label from fold agreement and confidence."""
    agreement, conf = col(agreement), col(conf)
    return (
        F.when((agreement >= 0.75) & (conf >= 0.60), "HIGH")
        .when((agreement >= 0.60) & (conf >= 0.40), "MODERATE")
        .when(agreement >= 0.50, "LOW")
        .otherwise("MIXED")
    )


def conviction_of_confidence(conf) -> Column:
    """Label from confidence alone."""
    conf = col(conf)
    return F.when(conf >= 0.70, "HIGH").when(conf >= 0.45, "MODERATE").when(conf >= 0.25, "LOW").otherwise("WEAK")


def trend_floor(position, raw_direction, above, floor=0.25) -> Column:
    """Keeps a minimum long position while the price is above its average (G8, floor)."""
    position = col(position)
    held = col(above) & (col(raw_direction) < 0)
    return F.when(held, F.greatest(position, F.lit(floor) if not isinstance(floor, Column) else floor)).otherwise(position)
