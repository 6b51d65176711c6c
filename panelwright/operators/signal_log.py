"""Outcomes of logged signals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import add_bdays
from ..functions.expr import as_list, ordered
from .panel import asof_join

# Age in business days from which outcomes are filled, and the outcome horizon in rows.
MIN_AGE, HORIZON = 12, 10


def outcome(entry: str, exit_: str) -> dict[str, Column]:
    """Return between two prices in percent, and whether ``direction`` foresaw its sign."""
    ret = (F.col(exit_) / F.col(entry) - 1) * 100
    side = F.when(F.col("direction") == "BULLISH", 1.0).otherwise(-1.0)
    return {"outcome_correct": F.signum(ret) == side, "outcome_actual": F.round(ret, 2)}


def backfill_outcomes(
    log: DataFrame, prices: DataFrame, today=None, min_age: int = MIN_AGE, horizon: int = HORIZON,
    by: Sequence[str] = ("symbol",), date: str = "date",
) -> DataFrame:
    """Fills missing outcomes of signals at least ``min_age`` business days old (K1).

    Entry is the first price on or after the signal date, exit ``horizon`` rows later.  ``today`` defaults to
    the last price date of the key.  Outcomes already logged stay as they are.
    """
    by = as_list(by)
    w = ordered(by, date)
    path = prices.select(*by, date, "close").withColumns(
        {"__exit": F.lead("close", horizon).over(w), "__prev": F.lag(date).over(w)}
    )
    # A price serves the signals dated after the previous price up to its own date; the first one all before it.
    after = F.coalesce(F.date_add("__prev", 1), F.col(date))
    entry = path.select(
        *by, F.explode(F.sequence(after, F.col(date), F.expr("interval 1 day"))).alias(date), F.col("close").alias("__entry"), "__exit"
    )
    head = path.groupBy(*by).agg(F.min_by(F.struct(F.col(date).alias("date"), "close", "__exit"), date).alias("__head"))
    out = log.join(entry, [*by, date], "left").join(head, by, "left")
    early = F.col(date) < F.col("__head.date")
    out = out.withColumns(
        {"__entry": F.when(early, F.col("__head.close")).otherwise(F.col("__entry")), "__exit": F.when(early, F.col("__head.__exit")).otherwise(F.col("__exit"))}
    ).drop("__head")
    if today is None:
        out = out.join(prices.groupBy(*by).agg(F.max(date).alias("__today")), by, "left")
    else:
        out = out.withColumn("__today", F.to_date(F.lit(today)))
    ripe = F.col("outcome_actual").isNull() & (F.col(date) <= add_bdays("__today", -min_age)) & F.col("__exit").isNotNull()
    found = outcome("__entry", "__exit")
    return out.withColumns({c: F.when(ripe, v).otherwise(F.col(c)) for c, v in found.items()}).drop("__entry", "__exit", "__today")


def signal_hits(
    signals: DataFrame, realised: DataFrame, tol_days: int = 3, by: Sequence[str] = ("symbol",), date: str = "date",
    pred: str = "pred", partitions: int | None = None,
) -> DataFrame:
    """Marks past signals against the realised return last seen within the tolerance (K2)."""
    joined = asof_join(signals, realised, ["actual"], by, date, max_age_days=tol_days, partitions=partitions)
    hit = ((F.col(pred) > 0) & (F.col("actual") > 0)) | ((F.col(pred) < 0) & (F.col("actual") < 0))
    return joined.withColumn("mark", F.when(F.col("actual").isNull(), "pending").when(hit, "hit").otherwise("miss"))
