"""Allocation of idle capital across sleeves and the books that result.

A sleeve table has one row per ``(book, date, sleeve)``; a book is one portfolio.  The cascade's window is one
day of one book (its sleeves), the capital windows are one row per day of one book.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import TRADING_DAYS, as_list, ordered, up_to_now, whole

BOOK = ("book",)
CAPITAL = 100_000.0

# Gate of the secondary sleeves and smallest idle share worth allocating.
MIN_PRED, MIN_CONF, MIN_IDLE = 0.002, 0.40, 0.01

# Yearly cash yield and one-way cost of the ledger with costs.
ROTATION_CASH_RATE, ROTATION_COST = 0.052, 0.0015


def cascade(
    sleeves: DataFrame,
    priority: str = "confidence",
    by: Sequence[str] = BOOK,
    min_pred: float = MIN_PRED,
    min_conf: float = MIN_CONF,
    min_idle: float = MIN_IDLE,
    date: str = "date",
) -> DataFrame:
    """Adds ``weight`` to rows ``(book, date, sleeve, rank, is_primary, pred, conf_pct, target)``.

    The primary sleeve gets its target.  The idle rest goes to the sleeves that pass the gate, in fixed order
    of ``rank`` (R1) or by confidence, ``rank`` breaking ties (R2): each takes the smaller of its target and
    what the sleeves before it left, or nothing once no more than ``min_idle`` is left.
    """
    day = [*as_list(by), date]
    if priority == "confidence":
        sort = [F.col("__passes").desc(), F.col("conf_pct").desc(), F.col("rank")]
    elif priority == "fixed":
        sort = [F.col("__passes").desc(), F.col("rank")]
    else:
        raise ValueError(f"unknown priority {priority!r}")
    passes = ~F.col("is_primary") & (F.col("pred") > min_pred) & (F.col("conf_pct") >= min_conf)
    df = sleeves.withColumn("__passes", passes)
    df = df.withColumn("__want", F.when(F.col("__passes"), F.col("target")).otherwise(0.0))
    primary = F.coalesce(F.max(F.when(F.col("is_primary"), F.col("target"))).over(Window.partitionBy(*day)), F.lit(0.0))
    before = Window.partitionBy(*day).orderBy(*sort).rowsBetween(Window.unboundedPreceding, -1)
    # The finer order first: it serves the day's window as well.
    df = df.withColumn("__taken", F.coalesce(F.sum("__want").over(before), F.lit(0.0))).withColumn("__primary", primary)
    df = df.withColumn("__left", (1 - F.col("__primary")) - F.col("__taken"))
    weight = (
        F.when(F.col("is_primary"), F.col("target"))
        .when(F.col("__passes") & (F.col("__left") > min_idle), F.least(F.col("__want"), F.col("__left")))
        .otherwise(0.0)
    )
    return df.withColumn("weight", weight).drop("__passes", "__want", "__taken", "__primary", "__left")


def book_days(weights: DataFrame, by: Sequence[str] = BOOK, date: str = "date") -> DataFrame:
    """One row per day of each book: ``__set``, the weights other than zero set on it, ``__rets``, the sleeves' returns, and
    ``__primary``, the sleeves that are primary on any day of the book.

    Windows by book and day take the order that the cascade has left, so the rows are sorted once and not multiplied.
    """
    by = as_list(by)
    day, along = Window.partitionBy(*by, date), ordered(by, date)
    weight, ret = F.col("weight").cast("double").alias("weight"), F.col("ret").cast("double").alias("ret")
    some = F.col("sleeve").isNotNull()
    known = weights.withColumns(
        {
            "__set": F.collect_list(F.when(some & (F.col("weight") != 0), F.struct("sleeve", weight))).over(day),
            "__rets": F.collect_list(F.when(some & F.col("ret").isNotNull(), F.struct("sleeve", ret))).over(day),
            "__primary": F.collect_set(F.when(F.col("is_primary"), F.col("sleeve"))).over(whole(by)),
        }
    )
    first = (F.col("__rn") == 1) | ~F.col("__last").eqNullSafe(F.col(date))
    marked = known.withColumns({"__rn": F.row_number().over(along), "__last": F.lag(date).over(along)}).filter(first)
    return marked.select(*by, date, "__set", "__rets", "__primary")


def _of(rows: str, sleeve: Column, field: str) -> Column:
    """The sleeve's value in an array of a day's rows, 0 without one."""
    return _total(rows, lambda x: F.when(x["sleeve"] == sleeve, x[field]).otherwise(0.0))


def _total(rows: str, value: Callable[[Column], Column]) -> Column:
    """Sum over an array, 0 for none."""
    return F.coalesce(F.aggregate(rows, F.lit(0.0), lambda a, x: a + value(x)), F.lit(0.0))


def rotation_ledger(
    weights: DataFrame,
    by: Sequence[str] = BOOK,
    lag: int = 1,
    cost: float = 0.0,
    cash_rate: float = 0.0,
    returns: str = "simple",
    hold: int = 1,
    capital: float = CAPITAL,
    date: str = "date",
) -> DataFrame:
    """Daily books from rows with ``weight`` and ``ret``.

    A weight set on one day earns the return ``lag`` of the book's days later (0 reproduces the same-day replay): a
    sleeve without a row on a day of its book has no weight and no return there.  Simple
    returns add up over sleeves; log returns spread over ``hold`` days are summed and exponentiated.  The
    primary-only book runs beside the rotation.
    """
    by = as_list(by)
    w = ordered(by, date)
    days = book_days(weights, by, date)
    days = days.withColumns({"__held": F.lag("__set", lag).over(w) if lag else F.col("__set"), "__before": F.lag("__set", lag + 1).over(w)})
    gain = lambda x: F.when(x["weight"] > 0, x["weight"] * _of("__rets", x["sleeve"], "ret") / hold).otherwise(0.0)
    primary = lambda x, v: F.when(F.array_contains("__primary", x["sleeve"]), v).otherwise(0.0)
    moved = lambda x: F.abs(x["weight"] - _of("__before", x["sleeve"], "weight"))
    left = lambda x: F.when(F.exists("__held", lambda y: y["sleeve"] == x["sleeve"]), 0.0).otherwise(F.abs(x["weight"]))
    days = days.select(
        *by, date,
        _total("__held", lambda x: x["weight"]).alias("invested"),
        _total("__held", gain).alias("gain"),
        _total("__held", lambda x: primary(x, gain(x))).alias("primary_gain"),
        (_total("__held", moved) + _total("__before", left)).alias("turnover"),
        _total("__held", lambda x: primary(x, x["weight"])).alias("primary_pos"),
    )
    cash = (1 - F.col("invested")) * (cash_rate / TRADING_DAYS)
    grow = (lambda g: F.exp(g)) if returns == "log" else (lambda g: 1 + g)
    days = days.withColumns(
        {
            "cash_pos": 1 - F.col("invested"),
            "factor": grow(F.col("gain")) + cash - F.col("turnover") * cost,
            "primary_factor": grow(F.col("primary_gain")),
        }
    )
    product = lambda c: F.exp(F.sum(F.ln(F.greatest(F.col(c), F.lit(1e-12)))).over(up_to_now(by, date))) * capital
    return days.withColumns({"rotation": product("factor"), "primary_only": product("primary_factor")})


def wide_weights(weights: DataFrame, sleeves: Sequence[str], by: Sequence[str] = BOOK, date: str = "date") -> DataFrame:
    """One column per sleeve plus cash: the ledger's wide form (R3); the sleeve list is given, so no extra scan."""
    wide = weights.groupBy(*as_list(by), date).pivot("sleeve", list(sleeves)).agg(F.sum("weight"))
    wide = wide.fillna(0.0, subset=list(sleeves))
    total = sum((F.col(s) for s in sleeves), F.lit(0.0))
    return wide.select(*as_list(by), date, *[F.col(s).alias(f"{s}_pos") for s in sleeves], (1 - total).alias("cash_pos"))


def yearly(
    led: DataFrame, prices: DataFrame | None = None, by: Sequence[str] = BOOK, capital: float = CAPITAL, date: str = "date"
) -> DataFrame:
    """Per calendar year: return from year-end to year-end, days invested, buy-and-hold of the given prices."""
    by = as_list(by)
    ends = led.groupBy(*by, F.year(date).alias("year")).agg(
        F.max_by("rotation", date).alias("end_rotation"),
        F.max_by("primary_only", date).alias("end_primary"),
        (F.avg((F.col("primary_pos") > 0).cast("double")) * 100).alias("primary_long_pct"),
        (F.avg((F.col("invested") > 0).cast("double")) * 100).alias("invested_pct"),
    )
    w = ordered(by, "year")
    change = lambda c: (F.col(c) / F.coalesce(F.lag(c).over(w), F.lit(float(capital))) - 1) * 100
    out = ends.withColumns({"rotation_ret_pct": change("end_rotation"), "primary_ret_pct": change("end_primary")})
    if prices is None:
        return out
    held = prices.groupBy(*by, F.year(date).alias("year")).agg(
        ((F.max_by("close", date) / F.min_by("close", date) - 1) * 100).alias("bh_ret_pct")
    )
    return out.join(held, [*by, "year"], "left")


def sleeve_years(weights: DataFrame, by: Sequence[str] = BOOK, date: str = "date") -> DataFrame:
    """Share of each year's days on which a sleeve is held."""
    return weights.groupBy(*as_list(by), "sleeve", F.year(date).alias("year")).agg(
        (F.avg((F.col("weight") > 0).cast("double")) * 100).alias("long_pct")
    )


def contribution(weights: DataFrame, by: Sequence[str] = BOOK, hold: int = 20) -> DataFrame:
    """Sum of each sleeve's log returns and its share of the total."""
    by = as_list(by)
    sums = weights.groupBy(*by, "sleeve").agg(
        (F.sum(F.col("weight") * F.coalesce(F.col("ret"), F.lit(0.0)) / hold) * 100).alias("contribution_pct")
    )
    total = F.sum("contribution_pct").over(Window.partitionBy(*by))
    return sums.withColumn("share_pct", F.try_divide(F.col("contribution_pct"), total) * 100)


def _growth(value: str, initial: float | None, date: str) -> Column:
    first = F.min_by(value, date) if initial is None else F.lit(float(initial))
    years = F.greatest(F.datediff(F.max(date), F.min(date)) / F.lit(365.25), F.lit(0.01))
    return (F.exp(F.ln(F.max_by(value, date) / first) / years) - 1) * 100


def cagr(df: DataFrame, value: str, by: Sequence[str], initial: float | None = None, date: str = "date") -> DataFrame:
    """Calendar-time growth rate per key."""
    return df.groupBy(*as_list(by)).agg(_growth(value, initial, date).alias("cagr_pct"))


def premium(led: DataFrame, prices: DataFrame, by: Sequence[str] = BOOK, capital: float = CAPITAL, date: str = "date") -> DataFrame:
    """Growth of the rotation over the primary-only book and over buy-and-hold (R6); the ledger is read once."""
    by = as_list(by)
    rates = {"rotation_cagr_pct": "rotation", "primary_cagr_pct": "primary_only"}
    both = led.groupBy(*by).agg(*[_growth(c, capital, date).alias(name) for name, c in rates.items()])
    held = cagr(prices, "close", by, date=date).withColumnRenamed("cagr_pct", "bh_cagr_pct")
    return both.join(held, by, "left").withColumns(
        {
            "premium_primary_pct": F.col("rotation_cagr_pct") - F.col("primary_cagr_pct"),
            "premium_bh_pct": F.col("rotation_cagr_pct") - F.col("bh_cagr_pct"),
        }
    )


def sleeve_days(weights: DataFrame, by: Sequence[str] = BOOK, date: str = "date") -> DataFrame:
    """Days and share of days each sleeve is held, and of cash-only days, as sleeve ``cash``."""
    by = as_list(by)
    daily = weights.groupBy(*by, date).agg((1 - F.sum("weight")).alias("weight")).withColumn("sleeve", F.lit("cash"))
    held = (F.col("sleeve") != "cash") & (F.col("weight") > 0) | (F.col("sleeve") == "cash") & (F.col("weight") >= 0.99)
    return weights.select(*by, date, "sleeve", "weight").unionByName(daily).groupBy(*by, "sleeve").agg(
        F.count_if(held).alias("days"), (F.avg(held.cast("double")) * 100).alias("days_pct")
    )
