"""Scalar helpers shared by all operators.

Spark runs with ANSI on: ``1D / 0D`` raises, so every ratio goes through ``try_divide``, and ``ln`` of a
non-positive number is NULL.  Missing values are always NULL, never NaN.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

EPS = 1e-9
TRADING_DAYS = 252


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(a, b) -> Column:
    return F.try_divide(col(a), col(b))


def safe_ln(c) -> Column:
    """Spark's ``ln`` is NULL for zero and below.  Guarding it again would name a window argument twice, and
    Spark computes every mention of a window function anew."""
    return F.ln(col(c))


def finite(c) -> Column:
    """NULL for NaN and for either infinity."""
    c = col(c)
    inf = float("inf")
    return F.when(~F.isnan(c) & (F.abs(c) != inf), c)


def correlation(a, b) -> Column:
    """Pearson correlation as an aggregate; NULL where either does not vary, for which ``corr`` raises under ANSI."""
    a, b = col(a), col(b)
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.try_divide(F.covar_pop(a, b), F.sqrt(F.var_pop(x) * F.var_pop(y)))


def clip(c, lower=None, upper=None) -> Column:
    """Bounds that leave NULL alone; ``greatest``/``least`` would skip it."""
    c = col(c)
    out = c
    if lower is not None:
        out = F.greatest(out, F.lit(lower))
    if upper is not None:
        out = F.least(out, F.lit(upper))
    return F.when(c.isNotNull(), out)


def r(c, digits: int = 6) -> Column:
    """Rounded double without a negative zero."""
    return F.round(col(c).cast("double"), digits) + F.lit(0.0)


def as_list(keys: str | Iterable[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def dealt(df: DataFrame, partitions: int | None, by) -> DataFrame:
    """``df`` in so many partitions by key, which Spark does not merge; as it is without a number."""
    return df.repartition(partitions, *as_list(by)) if partitions else df


def ordered(by, order="date", *more) -> WindowSpec:
    return Window.partitionBy(*as_list(by)).orderBy(order, *more)


def last_rows(by, n: int, order="date") -> WindowSpec:
    """The current row and the ``n - 1`` rows before it."""
    return ordered(by, order).rowsBetween(-(n - 1), 0)


def up_to_now(by, order="date") -> WindowSpec:
    return ordered(by, order).rowsBetween(Window.unboundedPreceding, 0)


def whole(by) -> WindowSpec:
    return Window.partitionBy(*as_list(by))


def ties(by, value) -> WindowSpec:
    """Rows tied with the current one; shares the sort of ``ordered(by, value)``."""
    return Window.partitionBy(*as_list(by)).orderBy(value).rangeBetween(Window.currentRow, Window.currentRow)


def avg_rank(by, value) -> Column:
    """1-based rank with ties averaged, from one sort: ``rank + (ties - 1) / 2``."""
    value = col(value)
    return F.rank().over(ordered(by, value)) + (F.count(F.lit(1)).over(ties(by, value)) - 1) / F.lit(2.0)
