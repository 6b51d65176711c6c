"""Calendars and densification."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import bday_index, is_bday
from ..functions.expr import as_list, ordered, whole


def bday_calendar(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Mon-Fri days between two dates with their running index."""
    days = spark.range(1).select(
        F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)), F.expr("interval 1 day"))).alias("date")
    )
    return days.filter(is_bday("date")).withColumn("bday_idx", bday_index("date"))


def bday_calendar_of(df: DataFrame, date: str = "date") -> DataFrame:
    """The Mon-Fri days spanned by a table; the span is one row, its days are bounded by the calendar."""
    span = df.agg(F.min(date).alias("lo"), F.max(date).alias("hi"))
    days = span.select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias("date"))
    return days.filter(is_bday("date")).withColumn("bday_idx", bday_index("date"))


def trading_days(df: DataFrame, date: str = "date") -> DataFrame:
    """Distinct dates numbered from 1.  ``distinct`` combines map-side; what is left is bounded by the
    number of days, so numbering it in one task is safe and the table may be broadcast."""
    days = df.select(F.col(date).alias("date")).distinct()
    w = Window.orderBy("date")
    return days.select("date", F.row_number().over(w).alias("day_idx")).withColumn(
        "n_days", F.count(F.lit(1)).over(Window.partitionBy())
    )


def densify(
    df: DataFrame,
    by: Sequence[str] = ("series",),
    date: str = "date",
    business_days: bool = True,
    end=None,
    max_age_days: int | None = None,
) -> DataFrame:
    """Sparse series to daily rows, each day carrying the last observation.

    Every observation is spread over the days until the next one, so there is neither a cross join with a
    calendar nor a fill window.  ``end`` extends the last observation (default: the last day seen in the key).
    """
    by = as_list(by)
    nxt = F.lead(date).over(ordered(by, date))
    stop = F.to_date(F.lit(end)) if isinstance(end, str) else end
    last_day = F.coalesce(F.date_sub(nxt, 1), stop if stop is not None else F.col(date))
    if max_age_days is not None:
        last_day = F.least(last_day, F.date_add(F.col(date), max_age_days))
    df = df.withColumn("__last", last_day).filter(F.col("__last") >= F.col(date))
    days = F.sequence(F.col(date), F.col("__last"), F.expr("interval 1 day"))
    if business_days:
        days = F.filter(days, lambda d: F.weekday(d) < 5)
    rest = [c for c in df.columns if c not in {*by, date, "__last"}]
    return df.select(*by, F.explode(days).alias(date), F.col(date).alias("observed"), *rest)


def panel_align(
    prices: DataFrame, by: Sequence[str] = ("symbol",), date: str = "date", calendar: DataFrame | None = None
) -> DataFrame:
    """Every symbol on every trading day from its first row on, values carried forward.

    Each row is spread over the trading days until the symbol's next row.  The calendar (one row per day)
    is broadcast twice; the panel is shuffled once, by symbol.
    """
    by = as_list(by)
    cal = trading_days(prices, date) if calendar is None else calendar
    rest = [c for c in prices.columns if c not in {*by, date}]
    placed = prices.join(cal.withColumnRenamed("date", date), date)
    nxt = F.coalesce(F.lead("day_idx").over(ordered(by, "day_idx")), F.col("n_days") + 1)
    spread = placed.withColumn("__next", nxt).select(
        *by, F.explode(F.sequence(F.col("day_idx"), F.col("__next") - 1)).alias("__idx"), F.col("day_idx"), *rest
    )
    back = cal.select(F.col("day_idx").alias("__idx"), F.col("date").alias(date))
    return spread.join(back, "__idx").select(
        *by, date, *rest, (F.col("__idx") != F.col("day_idx")).alias("filled")
    )


def last_window(df: DataFrame, days: int, by: Sequence[str] = (), date: str = "date") -> DataFrame:
    """Rows no older than ``days`` before the last date, overall or per key."""
    by = as_list(by)
    if by:
        latest = F.max(date).over(whole(by))
        return df.withColumn("__latest", latest).filter(
            F.col(date) >= F.date_sub("__latest", days)
        ).drop("__latest")
    return df.filter(F.col(date) >= F.date_sub(df.agg(F.max(date)).scalar(), days))
