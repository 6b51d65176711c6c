"""Windowed indicators on a long panel.

Every builder returns a Column over ``partitionBy(by).orderBy(date)``; indicators of other indicators are
built in stages (``withColumns`` twice), because window functions do not nest.  All builders of one stage
use the same partitioning and order, so Spark plans them on one shuffle and one sort.

A panel holds one row per ``by`` key and day (``operators.panel.normalize_dates`` guarantees it), so the
window group of the busiest symbol is bounded by the number of days, however much raw data it has.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .expr import EPS, TRADING_DAYS, as_list, clip, col, last_rows, ordered, ratio, safe_ln

ANNUAL = math.sqrt(TRADING_DAYS)
BY = ("symbol",)


def lagged(c, n: int, by=BY, order="date") -> Column:
    """Value ``n`` rows earlier; negative ``n`` looks ahead."""
    w = ordered(by, order)
    return F.lag(col(c), n).over(w) if n >= 0 else F.lead(col(c), -n).over(w)


def log_return(c, n: int = 1, by=BY, order="date") -> Column:
    """ln(x / x n rows earlier)."""
    return safe_ln(ratio(c, lagged(c, n, by, order)))


def forward_log_return(c, h: int, by=BY, order="date") -> Column:
    """ln(x h rows later / x)."""
    return safe_ln(ratio(lagged(c, -h, by, order), c))


def smoothed_target(c, horizons=(17, 18, 19, 20), by=BY, order="date") -> Column:
    """Mean forward log return over several horizons."""
    total = F.lit(0.0)
    for h in horizons:
        total = total + forward_log_return(c, h, by, order)
    return total / F.lit(float(len(horizons)))


def simple_return(c, n: int = 1, by=BY, order="date") -> Column:
    """x / x n rows earlier - 1 (I4, I16)."""
    return ratio(c, lagged(c, n, by, order)) - 1


def forward_simple_return(c, h: int, by=BY, order="date") -> Column:
    return ratio(lagged(c, -h, by, order), c) - 1


def difference(c, n: int, by=BY, order="date") -> Column:
    """x - x n rows earlier."""
    return col(c) - lagged(c, n, by, order)


def second_difference(c, n: int, by=BY, order="date") -> Column:
    """Difference of the difference, written out so that it needs one stage."""
    return col(c) - 2 * lagged(c, n, by, order) + lagged(c, 2 * n, by, order)


def gated(agg: Column, c, n: int, min_rows: int | None = None, by=BY, order="date") -> Column:
    """``agg`` over the last ``n`` rows, NULL until ``min_rows`` of them are filled (default: all)."""
    w = last_rows(by, n, order)
    return F.when(F.count(col(c)).over(w) >= (n if min_rows is None else min_rows), agg.over(w))


def rolling_mean(c, n: int, min_rows=None, by=BY, order="date") -> Column:
    """Mean of the last ``n`` rows (I6; I33 with ``min_rows=1``), the same at every window length."""
    return gated(F.avg(col(c)), c, n, min_rows, by, order)


def rolling_std(c, n: int, min_rows=None, by=BY, order="date") -> Column:
    """Sample standard deviation."""
    return gated(F.stddev_samp(col(c)), c, n, min_rows, by, order)


def rolling_vol(ret, n: int, by=BY, order="date") -> Column:
    """Annualised volatility of a return column."""
    return rolling_std(ret, n, by=by, order=order) * ANNUAL


def rolling_sum(c, n: int, min_rows=None, by=BY, order="date") -> Column:
    return gated(F.sum(col(c)), c, n, min_rows, by, order)


def rolling_min(c, n: int, min_rows=None, by=BY, order="date") -> Column:
    return gated(F.min(col(c)), c, n, min_rows, by, order)


def rolling_max(c, n: int, min_rows=None, by=BY, order="date") -> Column:
    return gated(F.max(col(c)), c, n, min_rows, by, order)


def rolling_z(c, n: int = TRADING_DAYS, min_rows: int | None = None, by=BY, order="date") -> Column:
    """(x - mean) / (std + eps) over the last ``n`` rows, half of them filled (I8).

    For many columns at once use ``operators.rolling.rolling_z_all``, whose cost does not grow with ``n``.
    """
    need = n // 2 if min_rows is None else min_rows
    c, w = col(c), last_rows(by, n, order)
    score = (c - F.avg(c).over(w)) / (F.stddev_samp(c).over(w) + EPS)
    return F.when(F.count(c).over(w) >= need, score)


def rolling_corr(a, b, n: int, by=BY, order="date") -> Column:
    """Pearson correlation of two columns over the last ``n`` rows (I10); NULL where one of them does not vary."""
    a, b, w = col(a), col(b), last_rows(by, n, order)
    both = a.isNotNull() & b.isNotNull()
    spread = F.var_pop(F.when(both, a)).over(w) * F.var_pop(F.when(both, b)).over(w)
    rho = F.try_divide(F.covar_pop(a, b).over(w), F.sqrt(spread))
    return F.when(F.count(F.when(both, F.lit(1))).over(w) >= n, rho)


def rsi(change, n: int = 14, by=BY, order="date") -> Column:
    """Relative strength index from a one-row change column, simple means."""
    up, down = clip(change, lower=0.0), -clip(change, upper=0.0)
    gain = rolling_mean(up, n, by=by, order=order)
    loss = rolling_mean(down, n, by=by, order=order)
    return strength(gain, loss)


def strength(gain, loss) -> Column:
    """Relative strength index from mean gain and loss."""
    return 100 - 100 / (1 + col(gain) / (col(loss) + EPS))


def above_low(c, n: int = 10, by=BY, order="date") -> Column:
    """Distance from the rolling minimum."""
    low = rolling_min(c, n, by=by, order=order)
    return (col(c) - low) / (low + EPS)


def share_true(flag, n: int, by=BY, order="date") -> Column:
    """Share of the last ``n`` rows on which a condition holds."""
    return rolling_mean(col(flag).cast("double"), n, by=by, order=order)


def rolling_sharpe(ret, n: int = 63, by=BY, order="date") -> Column:
    """mean / (population std + eps) * sqrt(252)."""
    mean = rolling_mean(ret, n, by=by, order=order)
    return mean / (gated(F.stddev_pop(col(ret)), ret, n, None, by, order) + EPS) * ANNUAL


def positioning(df: DataFrame) -> DataFrame:
    """Net positions, their share of open interest and the gap between the two sides."""
    net_spec, net_comm = F.col("spec_long") - F.col("spec_short"), F.col("comm_long") - F.col("comm_short")
    return df.withColumns(
        {
            "net_spec": net_spec,
            "net_comm": net_comm,
            "spec_oi_ratio": net_spec / (F.col("open_int") + EPS),
            "comm_oi_ratio": net_comm / (F.col("open_int") + EPS),
            "spec_comm_gap": net_spec - net_comm,
        }
    )


# Rows of a block within which an exponential mean is one running sum of scaled terms.
EMA_BLOCK = 32


def ema_columns(df: DataFrame, columns: dict[str, tuple[str, int]], by=BY, order="date") -> DataFrame:
    """Exponential means ``{new: (source, span)}`` with weight a = 2 / (span + 1) from the first row on.

    The recursion ``e = a x + (1 - a) e'`` is unrolled: within a block of rows it is a running sum of terms that are
    scaled by powers of ``1 - a``; the value before a block is the sum of the earlier blocks' ends, which fade by
    ``(1 - a) ** EMA_BLOCK`` each, so those that can still move the last digit are added.  Series without gaps only:
    a NULL has no weight of its own.
    """
    by, w = as_list(by), ordered(by, order)
    at = F.row_number().over(w) - 1
    df = df.withColumn("__at", at).withColumns({"__block": F.floor(F.col("__at") / EMA_BLOCK), "__in": F.col("__at") % EMA_BLOCK})
    inside = ordered([*by, "__block"], order).rowsBetween(Window.unboundedPreceding, 0)
    for name, (source, span) in columns.items():
        a = 2.0 / (span + 1)
        keep = 1.0 - a
        # The first value of a series counts in full, as if all values before it were the same.
        term = F.when(F.col("__at") == 0, col(source)).otherwise(a * col(source))
        part = F.sum(term * F.pow(F.lit(keep), -F.col("__in"))).over(inside) * F.pow(F.lit(keep), F.col("__in"))
        df = df.withColumn(f"__s_{name}", part)
        fades = keep**EMA_BLOCK
        blocks = next(k for k in range(1, 10_000) if fades**k < 1e-18)
        # One value per block: its end; earlier ends are found at a fixed distance in rows.
        before = F.lit(0.0)
        for k in range(blocks):
            end = F.lag(F.when(F.col("__in") == EMA_BLOCK - 1, F.col(f"__s_{name}")), 1 + k * EMA_BLOCK).over(w)
            before = before + F.coalesce(end, F.lit(0.0)) * fades**k
        start = F.max(F.when(F.col("__in") == 0, F.col(f"__b_{name}"))).over(ordered([*by, "__block"], order).rowsBetween(Window.unboundedPreceding, 0))
        df = df.withColumn(f"__b_{name}", before)
        df = df.withColumn(name, F.col(f"__s_{name}") + start * F.pow(F.lit(keep), F.col("__in") + 1)).drop(f"__s_{name}", f"__b_{name}")
    return df.drop("__at", "__block", "__in")


def macd(df: DataFrame, c: str = "close", fast=12, slow=26, signal=9, by=BY, order="date", name="macd_hist") -> DataFrame:
    """Fast minus slow exponential mean, less the exponential mean of that difference."""
    df = ema_columns(df, {"__fast": (c, fast), "__slow": (c, slow)}, by, order).withColumn("__line", F.col("__fast") - F.col("__slow"))
    df = ema_columns(df, {"__signal": ("__line", signal)}, by, order).withColumn(name, F.col("__line") - F.col("__signal"))
    return df.drop("__fast", "__slow", "__line", "__signal")
