"""Positions to equity: trades, mark-to-market, performance, benchmark, parameter sweeps.

A ledger's group is one strategy on one symbol under one configuration, at most one row per day.  The held
position is the target position, and capital is a running product: a pure window query.  Stops and overlays that
hold the previous position depend on the whole path day by day; such simulations are not built.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import EPS, TRADING_DAYS, as_list, dealt, ordered, ratio, safe_ln, up_to_now
from ..functions.indicators import rolling_mean
from .panel import asof_join
from .signals import BOND_YIELD, TIERS, build_signals, confidence

BY = ("strategy", "symbol")
CAPITAL = 100_000.0
HOLD = 20
COST, SLIPPAGE = 0.001, 0.0005
BOND_DAILY = math.log(1 + BOND_YIELD) / TRADING_DAYS


def _lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def ledger(
    signals: DataFrame,
    by: Sequence[str] = BY,
    hold: int = HOLD,
    cost=COST + SLIPPAGE,
    capital: float = CAPITAL,
    mode="cash_long",
    date: str = "date",
) -> DataFrame:
    """Daily mark-to-market without a stop (L2).

    Each day multiplies capital by ``exp(position * actual / hold) - |position change| * cost``; flat days of
    the cash-and-bonds mode earn the bond yield.  ``ret_gross`` ignores costs, ``ret_net`` includes them.
    """
    w = ordered(by, date)
    change = F.col("position") - F.coalesce(F.lag("position").over(w), F.lit(0.0))
    bonds = (_lit(mode) == "cash_bonds") & (F.col("position") == 0)
    gross = F.when(bonds, F.lit(BOND_DAILY)).otherwise(F.col("position") * F.col("actual") / hold)
    out = signals.withColumn("pos_change", change).withColumn("ret_gross", gross)
    factor = F.exp("ret_gross") - F.abs("pos_change") * _lit(cost)
    out = out.withColumn("ret_net", F.ln(F.greatest(factor, F.lit(1e-12))))
    return out.withColumn("log_capital", F.sum("ret_net").over(up_to_now(by, date)) + math.log(capital)).withColumn(
        "capital", F.exp("log_capital")
    )


def trades(
    led: DataFrame, by: Sequence[str] = BY, cost=COST + SLIPPAGE, initial: float = CAPITAL, rebal_days: int = 10, date="date"
) -> DataFrame:
    """One row per position change: type, reason, sizing note, cost and the split after it (L1).

    Reasons in order of precedence: a stop (where the ledger has a column ``stopped``), a change of side, a
    rebalance due after ``rebal_days`` rows without a trade, then entering, exiting or a change of size.  The
    names of trades, reasons and sizes are fixed values.
    """
    w = ordered(by, date)
    old = F.coalesce(F.lag("position").over(w), F.lit(0.0))
    before = F.coalesce(F.lag("capital").over(w), F.lit(float(initial)))
    rows = led.withColumns({"old_pos": old, "capital_before": before, "__rn": F.row_number().over(w)})
    rows = rows.withColumnRenamed("position", "new_pos")
    rows = rows.withColumn("__moved", F.abs(F.col("new_pos") - F.col("old_pos")) > 1e-6)
    last_trade = F.max(F.when(F.col("__moved"), F.col("__rn"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("__age", F.col("__rn") - F.coalesce(last_trade, F.lit(1))).filter("__moved")
    entering = (F.col("old_pos") == 0) & (F.col("new_pos") != 0)
    exiting = (F.col("old_pos") != 0) & (F.col("new_pos") == 0)
    flip = F.signum("old_pos") * F.signum("new_pos") < 0
    stopped = F.col("stopped") if "stopped" in led.columns else F.lit(False)
    conf = F.col("conf_pct")
    quartile = F.when(conf >= 0.75, "top").when(conf >= 0.50, "third").when(conf >= 0.25, "second").otherwise("bottom")
    return rows.withColumns(
        {
            "trade": F.when(entering, "BUY").when(exiting | stopped, "SELL").when(F.col("new_pos") > F.col("old_pos"), "ADD").otherwise("TRIM"),
            "reason": F.when(stopped, "stop_loss").when(flip, "dir_flip").when(F.col("__age") >= rebal_days, "weekly")
            .when(entering, "entering").when(exiting, "exiting").otherwise("size_chg"),
            "size_reason": F.when(F.col("new_pos") == 0, "flat").otherwise(F.concat(quartile, F.lit(" quartile"))),
            "cost": F.abs(F.col("new_pos") - F.col("old_pos")) * _lit(cost) * F.col("capital_before"),
            "stock_value": F.col("capital_before") * F.col("new_pos"),
            "cash_value": F.col("capital_before") * (1 - F.col("new_pos")),
        }
    ).drop("__rn", "__moved", "__age")


def days_held(df: DataFrame, by: Sequence[str] = BY, date: str = "date", position: str = "position") -> DataFrame:
    """Rows since the last position change, 1 on the day of the change (L3)."""
    w = ordered(by, date)
    changed = (F.col(position) != F.coalesce(F.lag(position).over(w), F.lit(0.0))).cast("int")
    df = df.withColumn("run_id", F.sum(changed).over(up_to_now(by, date)))
    return df.withColumn("days_held", F.row_number().over(ordered([*as_list(by), "run_id"], date)))


def drawdown(led: DataFrame, by: Sequence[str] = BY, capital: str = "capital", initial: float | None = None, date="date") -> DataFrame:
    """Capital relative to its running peak (L6); the initial capital counts as a peak when given."""
    peak = F.max(capital).over(up_to_now(by, date))
    if initial is not None:
        peak = F.greatest(peak, F.lit(float(initial)))
    return led.withColumn("drawdown", F.col(capital) / peak - 1)


def perf(led: DataFrame, by: Sequence[str] = BY, initial: float = CAPITAL, date: str = "date") -> DataFrame:
    """Performance metrics per group (L5): returns and drawdown net of costs, volatility and Sharpe gross."""
    led = drawdown(led, by, initial=initial, date=date)
    pos, ret = F.col("position"), F.col("ret_gross")
    active = F.when(pos != 0, ret)
    win, lose = F.when(active > 0, active), F.when(active <= 0, active)
    n = F.count(F.lit(1))
    share = lambda cond: F.avg(F.when(cond, 1.0).otherwise(0.0)) * 100
    final = F.max_by("capital", date)
    years = F.greatest(F.datediff(F.max(date), F.min(date)) / F.lit(365.25), F.lit(0.01))
    std = F.stddev_pop(ret)
    wins, losses = F.count(win), F.count(lose)
    return led.groupBy(*as_list(by)).agg(
        ((final / initial - 1) * 100).alias("total_return_pct"),
        ((F.exp(F.ln(final / initial) / years) - 1) * 100).alias("annual_return_pct"),
        years.alias("cal_years"),
        (std * math.sqrt(TRADING_DAYS) * 100).alias("volatility_pct"),
        (F.avg(ret) / (std + EPS) * math.sqrt(TRADING_DAYS)).alias("sharpe"),
        (F.least(F.min("drawdown"), F.lit(0.0)) * 100).alias("max_drawdown_pct"),
        share(pos > 0).alias("long_days_pct"),
        share(pos < 0).alias("short_days_pct"),
        share(pos == 0).alias("flat_days_pct"),
        F.coalesce(F.try_divide(wins * 100.0, wins + losses), F.lit(0.0)).alias("win_rate_pct"),
        F.coalesce(F.avg(win) * 100, F.lit(0.0)).alias("avg_win_pct"),
        F.coalesce(F.avg(lose) * 100, F.lit(0.0)).alias("avg_loss_pct"),
        (F.coalesce(F.sum(win), F.lit(0.0)) / (F.abs(F.coalesce(F.sum(lose), F.lit(0.0))) + EPS)).alias("profit_factor"),
        F.count(F.when(F.abs("pos_change") > 1e-6, 1)).alias("n_trades"),
        final.alias("final_capital"),
        n.alias("total_days"),
    )


def perf_daily(led: DataFrame, by: Sequence[str], capital: str = "capital", date: str = "date") -> DataFrame:
    """The trading-year variant: n / 252 years, sample deviation of simple capital returns."""
    w = ordered(by, date)
    led = led.withColumn("__ret", F.col(capital) / F.lag(capital).over(w) - 1)
    led = drawdown(led, by, capital=capital, date=date)
    first, last = F.min_by(capital, date), F.max_by(capital, date)
    years = F.count(F.lit(1)) / F.lit(float(TRADING_DAYS))
    std = F.stddev_samp("__ret")
    return led.groupBy(*as_list(by)).agg(
        ((last / first - 1) * 100).alias("total_return_pct"),
        ((F.pow(last / first, 1 / years) - 1) * 100).alias("annual_return_pct"),
        (std * math.sqrt(TRADING_DAYS) * 100).alias("volatility_pct"),
        F.when(std > 0, F.avg("__ret") / std * math.sqrt(TRADING_DAYS)).otherwise(0.0).alias("sharpe"),
        (F.min("drawdown") * 100).alias("max_drawdown_pct"),
        last.alias("final_capital"),
    )


def benchmark(
    prices: DataFrame, dates: DataFrame, by: Sequence[str] = ("symbol",), capital: float = CAPITAL, date="date", partitions: int | None = None
) -> DataFrame:
    """Buy-and-hold equity on the ledger's dates.

    The price in force on each date is an as-of lookup; dates before the first price take the first price,
    and a key without prices stays flat.
    """
    by = as_list(by)
    aligned = dealt(asof_join(dates.select(*by, date).distinct(), prices, ["close"], by, date, partitions=partitions), partitions, by)
    w = ordered(by, date)
    start = F.first("close", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    equity = F.coalesce(F.coalesce(F.col("close"), start) / start, F.lit(1.0)) * capital
    out = aligned.withColumn("capital", equity)
    return out.withColumn("ret", safe_ln(ratio("capital", F.lag("capital").over(w))))


def benchmark_from_returns(preds: DataFrame, by: Sequence[str] = BY, hold: int = HOLD, capital: float = CAPITAL, date="date") -> DataFrame:
    """Fallback without prices: compound the realised forward returns spread over the holding period."""
    return preds.withColumn(
        "capital", F.exp(F.sum(F.col("actual") / hold).over(up_to_now(by, date))) * capital
    )


def benchmark_perf(bench: DataFrame, by: Sequence[str] = ("symbol",), date: str = "date") -> DataFrame:
    bench = drawdown(bench, by, date=date)
    first, last = F.min_by("capital", date), F.max_by("capital", date)
    years = F.greatest(F.datediff(F.max(date), F.min(date)) / F.lit(365.25), F.lit(0.01))
    return bench.groupBy(*as_list(by)).agg(
        ((last / first - 1) * 100).alias("bh_total_return_pct"),
        ((F.exp(F.ln(last / first) / years) - 1) * 100).alias("bh_annual_return_pct"),
        F.coalesce(F.avg("ret") / (F.stddev_pop("ret") + EPS) * math.sqrt(TRADING_DAYS), F.lit(0.0)).alias("bh_sharpe"),
        (F.min("drawdown") * 100).alias("bh_max_drawdown_pct"),
    )


def alpha(performance: DataFrame, bench: DataFrame, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Excess total and annual return over buy-and-hold."""
    joined = performance.join(bench, as_list(by), "left")
    return joined.withColumns(
        {
            "alpha_pct": F.col("total_return_pct") - F.col("bh_total_return_pct"),
            "alpha_annual_pct": F.col("annual_return_pct") - F.col("bh_annual_return_pct"),
        }
    )


# The ten shipped configurations
# (name, max_pos, min_signal, mode, cost, stop, trend, floor); every cost adds the slippage.
CONFIGS = (
    ("Base (ML only)", 1.00, 0.008, "cash_long", 0.001, 0.08, "off", 0.0),
    ("Cash/bonds", 1.00, 0.008, "cash_bonds", 0.001, 0.08, "off", 0.0),
    ("Conservative 20%", 0.20, 0.008, "cash_long", 0.001, 0.08, "off", 0.0),
    ("High threshold", 1.00, 0.020, "cash_long", 0.001, 0.08, "off", 0.0),
    ("Low threshold", 1.00, 0.004, "cash_long", 0.001, 0.08, "off", 0.0),
    ("No stop loss", 1.00, 0.008, "cash_long", 0.001, None, "off", 0.0),
    ("High cost 0.3%", 1.00, 0.008, "cash_long", 0.003, 0.08, "off", 0.0),
    ("Long/short ref", 0.20, 0.008, "long_short", 0.001, 0.08, "off", 0.0),
    ("Trend floor 10% 50d", 1.00, 0.008, "cash_long", 0.001, 0.08, "floor", 0.10),
    ("Trend soft 50d", 1.00, 0.008, "cash_long", 0.001, 0.08, "soft", 0.25),
)


def with_configs(df: DataFrame, configs: Sequence[tuple] = CONFIGS) -> DataFrame:
    """Every row once per configuration: the grid is a literal array exploded in place, not a join."""
    rows = [
        F.struct(
            F.lit(c[0]).alias("config"), F.lit(float(c[1])).alias("max_pos"), F.lit(float(c[2])).alias("min_signal"),
            F.lit(c[3]).alias("mode"), F.lit(float(c[4])).alias("tc"),
            F.lit(None if c[5] is None else float(c[5])).cast("double").alias("stop_pct"),
            F.lit(c[6]).alias("trend_mode"), F.lit(float(c[7])).alias("trend_floor"),
        )
        for c in configs
    ]
    return df.withColumn("__cfg", F.explode(F.array(*rows))).select("*", "__cfg.*").drop("__cfg")


def sweep(
    preds: DataFrame, configs: Sequence[tuple] = CONFIGS, by: Sequence[str] = BY, hold: int = HOLD,
) -> DataFrame:
    """Metrics per configuration and group.

    Confidence does not depend on the configuration and is ranked once, before the grid multiplies the rows.
    Stops and overlays of a configuration are not simulated.
    """
    keys = ["config", *as_list(by)]
    ranked = confidence(preds, "whole", by)
    grid = build_signals(
        with_configs(ranked, configs), F.col("min_signal"), F.col("mode"), F.col("max_pos"), TIERS, None, keys
    )
    return perf(ledger(grid, keys, hold, F.col("tc") + SLIPPAGE, mode=F.col("mode")), keys)


def above_average(prices: DataFrame, n: int = 50, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Price above its n-row mean, for the trend overlays."""
    return prices.withColumn("above_ma", F.coalesce(F.col("close") > rolling_mean("close", n, by=by), F.lit(False)))


def transitions(led: DataFrame, by: Sequence[str] = BY, date: str = "date", position: str = "position") -> DataFrame:
    """Entry (flat to long) and exit (long to flat) markers."""
    prev = F.coalesce(F.lag(position).over(ordered(by, date)), F.lit(0.0))
    pos = F.col(position)
    marked = led.withColumn("marker", F.when((prev <= 0) & (pos > 0), "entry").when((prev > 0) & (pos <= 0), "exit"))
    return marked.filter(F.col("marker").isNotNull())


def conf_bins(signals: DataFrame, by: Sequence[str] = BY, bins: int = 10, min_rows: int = 3, value: str = "actual") -> DataFrame:
    """Mean return per equal-width confidence bin with more than two rows."""
    b = F.least(F.floor(F.col("conf_pct") * bins), F.lit(bins - 1)).cast("int")
    out = signals.withColumn("bin", b).groupBy(*as_list(by), "bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean_value")
    )
    return out.filter(F.col("n") >= min_rows)


def ret_hist(df: DataFrame, by: Sequence[str] = BY, value: str = "actual", bins: int = 40) -> DataFrame:
    """Histogram between the 1st and 99th percentile (L12); the percentiles are per key, exact."""
    by = as_list(by)
    cut = df.groupBy(*by).agg(
        F.expr(f"percentile({value}, 0.01)").alias("lo"), F.expr(f"percentile({value}, 0.99)").alias("hi")
    )
    inside = df.join(cut, by).filter(F.col(value).between(F.col("lo"), F.col("hi")))
    step = (F.col("hi") - F.col("lo")) / bins
    b = F.least(F.floor(F.try_divide(F.col(value) - F.col("lo"), step)), F.lit(bins - 1)).cast("int")
    return inside.withColumn("bin", F.coalesce(b, F.lit(0))).groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))


def cum_signal(preds: DataFrame, by: Sequence[str] = BY, date: str = "date") -> DataFrame:
    """Running log return of the sign strategy and of always-long."""
    w = up_to_now(by, date)
    return preds.withColumns(
        {
            "cum_strategy": F.sum(F.signum("pred") * F.col("actual")).over(w),
            "cum_long": F.sum("actual").over(w),
        }
    )


# Yearly yield of idle cash in the live replay.
CASH_RATE = 0.0


def extend_ledger(
    led: DataFrame, prices: DataFrame, positions: DataFrame | None = None, by: Sequence[str] = ("symbol",),
    cash_rate: float = CASH_RATE, date: str = "date",
) -> DataFrame:
    """Continues each ledger past its last day with newer prices.

    A new day holds its own position where one is given, else the ledger's last one, and multiplies capital
    by ``(1 + price return * position) * (1 + idle share * daily cash rate)``.  The last capital and position
    per key are one small aggregate, joined by key.
    """
    by = as_list(by)
    last = led.groupBy(*by).agg(
        F.max(date).alias("__from"), F.max_by("capital", date).alias("__cap"), F.max_by("position", date).alias("__pos")
    )
    w = ordered(by, date)
    moved = prices.withColumn("__ret", F.col("close") / F.lag("close").over(w) - 1)
    new = moved.join(last, by).filter(F.col(date) > F.col("__from"))
    if positions is not None:
        given = positions.select(*by, date, F.col("position").alias("__given"))
        new = new.join(given, [*by, date], "left").withColumn("__pos", F.coalesce("__given", "__pos"))
    ret = F.when(F.col("__pos") > 0, F.coalesce("__ret", F.lit(0.0)) * F.col("__pos")).otherwise(0.0)
    factor = (1 + ret) * (1 + (1 - F.col("__pos")) * (cash_rate / TRADING_DAYS))
    new = new.withColumn("capital", F.col("__cap") * F.exp(F.sum(F.ln(factor)).over(up_to_now(by, date))))
    tail = new.select(*by, date, "capital", F.col("__pos").alias("position"), F.lit(True).alias("extended"))
    head = led.select(*by, date, "capital", "position", F.lit(False).alias("extended"))
    return head.unionByName(tail).withColumns(
        {"stock": F.col("capital") * F.col("position"), "cash": F.col("capital") * (1 - F.col("position"))}
    )


def portfolio_summary(
    led: DataFrame, prices: DataFrame, by: Sequence[str] = ("symbol",), initial: float = CAPITAL, date: str = "date"
) -> DataFrame:
    """Value, split, shares, CAGR since the first trade, buy-and-hold since then, trade count."""
    by = as_list(by)
    w = ordered(by, date)
    moved = F.abs(F.col("position") - F.coalesce(F.lag("position").over(w), F.lit(0.0))) > 1e-6
    book = led.withColumn("__moved", moved).groupBy(*by).agg(
        F.max(date).alias("last_date"),
        F.coalesce(F.min(F.when(F.col("__moved"), F.col(date))), F.min(date)).alias("first_trade"),
        F.count(F.when(F.col("__moved"), 1)).alias("n_trades"),
        F.max_by("capital", date).alias("value"),
        F.max_by("position", date).alias("position"),
    )
    quotes = prices.join(book.select(*by, "first_trade"), by).groupBy(*by).agg(
        F.max_by("close", date).alias("last_close"),
        F.min_by(F.when(F.col(date) >= F.col("first_trade"), F.col("close")), F.when(F.col(date) >= F.col("first_trade"), F.col(date))).alias("first_close"),
    )
    out = book.join(quotes, by)
    years = F.greatest(F.datediff("last_date", "first_trade") / F.lit(365.25), F.lit(0.01))
    return out.withColumns(
        {
            "stock_value": F.col("value") * F.col("position"),
            "cash_value": F.col("value") * (1 - F.col("position")),
            "shares": F.col("value") * F.col("position") / (F.col("last_close") + EPS),
            "total_return_pct": (F.col("value") / initial - 1) * 100,
            "annual_return_pct": (F.exp(F.ln(F.greatest(F.col("value"), F.lit(1.0)) / initial) / years) - 1) * 100,
            "bh_value": F.lit(float(initial)) / F.col("first_close") * F.col("last_close"),
            "bh_return_pct": (F.col("last_close") / F.col("first_close") - 1) * 100,
        }
    )
