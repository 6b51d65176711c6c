"""Cross-instrument screens against an anchor, and basis risk of pairs."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import TRADING_DAYS, correlation, ordered
from ..functions.indicators import forward_log_return, gated, log_return

# Regimes of the anchor's forward return; they overlap on purpose.
LOSING, FLAT_LOW, FLAT_HIGH, WEAK = -0.03, -0.03, 0.03, 0.02
REGIMES = ("losing", "flat", "weak")
REGIME_FIELDS = ("n", "mean_pct", "hit_rate_pct", "sharpe", "alpha_pct", "std_pct", "score")

# Smallest joint history, regime and correlation samples, and the liquidity floor.
MIN_OBS, MIN_REGIME, MIN_CORR, MIN_DOLLAR_VOLUME = 100, 20, 30, 25_000_000.0


def returns_panel(panel: DataFrame, horizon: int = 20, anchor: str | None = None) -> DataFrame:
    """Forward and daily log returns and the rolling dollar volume of every symbol."""
    df = panel.withColumn("__dv", F.col("close") * F.col("volume"))
    return df.withColumns(
        {
            "fwd": forward_log_return("close", horizon),
            "daily": log_return("close", 1),
            "dollar_volume": gated(F.avg("__dv"), "__dv", TRADING_DAYS),
        }
    ).drop("__dv")


def against_anchor(returns: DataFrame, anchor: str) -> DataFrame:
    """Every candidate row beside the anchor's returns of that day.

    The anchor is one row per day, so it is broadcast and no candidate row is shuffled.
    """
    ref = returns.filter(F.col("symbol") == anchor).select(
        "date", F.col("fwd").alias("anchor_fwd"), F.col("daily").alias("anchor_daily")
    )
    return returns.filter(F.col("symbol") != anchor).join(ref, "date", "left")


def regimes(df: DataFrame, value: str = "anchor_fwd") -> DataFrame:
    """One row per regime the anchor's forward return falls in."""
    v = F.col(value)
    hits = F.array_compact(
        F.array(
            F.when(v < LOSING, F.lit("losing")),
            F.when((v >= FLAT_LOW) & (v <= FLAT_HIGH), F.lit("flat")),
            F.when(v < WEAK, F.lit("weak")),
        )
    )
    return df.withColumn("regime", F.explode(hits))


def _inside(v) -> dict:
    return {"losing": v < LOSING, "flat": (v >= FLAT_LOW) & (v <= FLAT_HIGH), "weak": v < WEAK}


def _moments(fwd) -> list:
    """One struct of plain moments per regime over a candidate's joint forward returns."""
    out = []
    for name, cond in _inside(F.col("anchor_fwd")).items():
        x = F.when(cond, fwd)
        out.append(
            F.struct(
                F.lit(name).alias("regime"), F.count(x).alias("n"), F.avg(x).alias("mean"),
                F.stddev_samp(x).alias("std"), F.avg((x > 0).cast("double")).alias("hit"),
            ).alias(name)
        )
    return out


def _figures(s, overall_mean, min_rows: int) -> dict:
    """Regime figures from its moments; NULL below the smallest sample."""
    mean, std = s["mean"], s["std"]
    alpha, std_pct = (mean - overall_mean) * 100, std * 100
    keep = lambda c: F.when(s["n"] >= min_rows, c)
    moving = std > 0
    sign = F.when(alpha >= 0, 1.0).otherwise(-1.0)
    return {
        "n": s["n"],
        "mean_pct": keep(mean * 100),
        "hit_rate_pct": keep(s["hit"] * 100),
        "sharpe": keep(F.when(moving, mean / std).otherwise(0.0)),
        "alpha_pct": keep(alpha),
        "std_pct": keep(F.when(moving, std_pct).otherwise(0.0)),
        "score": keep(F.when(moving, sign * F.abs(alpha) * F.sqrt(std_pct)).otherwise(0.0)),
    }


def regime_stats(joint: DataFrame, by: Sequence[str] = ("symbol",), min_rows: int = MIN_REGIME) -> DataFrame:
    """Statistics of candidate forward returns per anchor regime (X2); NULL below ``min_rows`` rows.

    One aggregation over the joint rows gives the overall mean and every regime; nothing is joined back.
    """
    both = F.col("fwd").isNotNull() & F.col("anchor_fwd").isNotNull()
    stats = joint.filter(both).groupBy(*by).agg(F.avg("fwd").alias("__mean"), *_moments(F.col("fwd")))
    long = stats.select(*by, "__mean", F.explode(F.array(*REGIMES)).alias("s"))
    figures = _figures(F.col("s"), F.col("__mean"), min_rows)
    return long.select(*by, F.col("s.regime").alias("regime"), *[c.alias(n) for n, c in figures.items()])


def screen(
    panel: DataFrame,
    anchor: str,
    horizon: int = 20,
    min_dollar_volume: float = MIN_DOLLAR_VOLUME,
    min_obs: int = MIN_OBS,
    attributes: DataFrame | None = None,
) -> DataFrame:
    """One wide row per candidate: overall, per-regime and liquidity figures, correlation with the anchor.

    All figures come from one aggregation of the candidate rows beside the broadcast anchor.
    """
    both = against_anchor(returns_panel(panel, horizon), anchor)
    joint = F.col("fwd").isNotNull() & F.col("anchor_fwd").isNotNull()
    pair = F.col("daily").isNotNull() & F.col("anchor_daily").isNotNull()
    fwd = F.when(joint, F.col("fwd"))
    volume = F.coalesce(F.avg("dollar_volume"), F.lit(0.0))
    corr = correlation(F.when(pair, F.col("daily")), F.when(pair, F.col("anchor_daily")))
    stats = both.groupBy("symbol").agg(
        F.count(fwd).alias("n_obs"),
        (volume / 1e6).alias("avg_daily_dollar_vol_M"),
        (volume >= min_dollar_volume).alias("passes_liquidity"),
        (F.avg(fwd) * 100).alias("overall_mean_pct"),
        (F.stddev_samp(fwd) * 100).alias("overall_std_pct"),
        F.when(F.count(F.when(pair, 1)) > MIN_CORR, corr).alias("corr_with_anchor"),
        F.avg(fwd).alias("__mean"),
        *_moments(fwd),
    ).filter(F.col("n_obs") >= min_obs)
    wide = {
        f"{g}_{n}": c for g in REGIMES for n, c in _figures(F.col(g), F.col("__mean"), MIN_REGIME).items()
    }
    out = stats.withColumns(wide).drop("__mean", *REGIMES)
    return out if attributes is None else out.join(attributes, "symbol", "left")


def top_k(screened: DataFrame, by: str = "score", k: int = 10, regimes: Sequence[str] = REGIMES) -> DataFrame:
    """Best liquid candidates per regime by score or alpha.

    Spark turns the bound on the row number into a top-k per task before the shuffle, so a regime's group
    holds ``k`` rows of each task and not all candidates.
    """
    cols = ", ".join(f"'{r}', {r}_{by}" for r in regimes)
    long = screened.filter("passes_liquidity").selectExpr("symbol", f"stack({len(regimes)}, {cols}) AS (regime, value)")
    place = F.row_number().over(Window.partitionBy("regime").orderBy(F.desc("value"), "symbol"))
    return long.filter(F.col("value").isNotNull()).withColumn("rank", place).filter(F.col("rank") <= k)


def lowest_correlation(screened: DataFrame, k: int = 10) -> DataFrame:
    """Liquid candidates least correlated with the anchor."""
    return screened.filter("passes_liquidity").orderBy("corr_with_anchor", "symbol").limit(k).select("symbol", "corr_with_anchor")


# Look-back windows in days and the smallest sample of each.
BASIS_WINDOWS = (("full", None), ("5y", 5 * 365), ("2y", 2 * 365))
MIN_WINDOW_ROWS = 50


def basis_risk(panel: DataFrame, pairs: DataFrame, horizon: int = 20, windows=BASIS_WINDOWS) -> DataFrame:
    """Correlation, beta, tracking error, volatility and return of each pair per look-back window.

    Pairs join the panel by symbol and then by (pair, day); both are equality joins.  Residual variance
    follows from the pair's moments, so one aggregation suffices.
    """
    keys = ["original", "substitute"]
    a = panel.select(F.col("symbol").alias("original"), "date", F.col("close").alias("o"))
    b = panel.select(F.col("symbol").alias("substitute"), "date", F.col("close").alias("s"))
    joined = a.join(pairs, "original").join(b, ["substitute", "date"]).dropna("any", subset=["o", "s"])
    w = ordered(keys, "date")
    df = joined.withColumns(
        {
            "__prev": F.lag("date").over(w),
            "__ro": F.ln(F.col("o") / F.lag("o").over(w)), "__rs": F.ln(F.col("s") / F.lag("s").over(w)),
            "__fo": F.ln(F.lead("o", horizon).over(w) / F.col("o")), "__fs": F.ln(F.lead("s", horizon).over(w) / F.col("s")),
            "__end": F.max("date").over(Window.partitionBy(*keys)),
        }
    )
    inside = [
        F.when(F.lit(True) if days is None else F.col("date") >= F.date_sub("__end", days), F.lit(name))
        for name, days in windows
    ]
    df = df.withColumn("window", F.explode(F.array_compact(F.array(*inside))))
    # The first return of a window would reach back across its start.
    starts = F.lit(False)
    for name, days in windows:
        if days is not None:
            starts = starts | ((F.col("window") == name) & (F.col("__prev") < F.date_sub("__end", days)))
    daily = ~F.coalesce(starts, F.lit(False)) & F.col("__ro").isNotNull() & F.col("__rs").isNotNull()
    o, s = F.when(daily, F.col("__ro")), F.when(daily, F.col("__rs"))
    fwd = F.col("__fo").isNotNull() & F.col("__fs").isNotNull()
    stats = df.groupBy(*keys, "window").agg(
        F.count(F.lit(1)).alias("__rows"), F.count(o).alias("n"), correlation(o, s).alias("daily_corr"),
        F.covar_samp(o, s).alias("__cov"), F.var_samp(o).alias("__vo"), F.var_samp(s).alias("__vs"),
        F.avg(o).alias("__mo"), F.avg(s).alias("__ms"),
        F.when(F.count(F.when(fwd, 1)) > 20, correlation(F.when(fwd, F.col("__fo")), F.when(fwd, F.col("__fs")))).alias("fwd_corr"),
    ).filter(F.col("__rows") >= MIN_WINDOW_ROWS)
    beta = F.try_divide("__cov", "__vo")
    annual = math.sqrt(TRADING_DAYS) * 100
    residual = F.col("__vs") + beta * beta * F.col("__vo") - 2 * beta * F.col("__cov")
    return stats.select(
        *keys, "window", "n", "daily_corr", beta.alias("beta"), "fwd_corr",
        (F.sqrt(F.greatest(residual, F.lit(0.0))) * annual).alias("tracking_error_pct"),
        (F.sqrt("__vo") * annual).alias("ann_vol_o_pct"), (F.sqrt("__vs") * annual).alias("ann_vol_s_pct"),
        (F.col("__mo") * TRADING_DAYS * 100).alias("ann_ret_o_pct"), (F.col("__ms") * TRADING_DAYS * 100).alias("ann_ret_s_pct"),
    )
