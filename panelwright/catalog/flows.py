"""End-to-end flows E0-E4."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import r
from ..operators import forecast as fc
from ..plans import flows
from ..sources import driver
from .base import ORACLES, PERF_COLUMNS, cols, ledger_sql, out, perf_sql, prices_sql, query, rnd, signals_sql, windows, zscore
from .forecasts import FOLD, METRICS_SQL, NAMES, RIDGE_SQL, TWO, two_feature_folds
from .ledgers import BENCH, PERM_SQL
from .rotations import FLOOR, primary_prices, screen_panel, sleeves

E0_SQL = "WITH " + prices_sql() + """, d AS (SELECT DISTINCT date FROM prices), s AS (SELECT symbol, min(date) AS lo FROM prices GROUP BY 1), grid AS (SELECT symbol, date FROM d JOIN s ON date>=lo),
    al AS (SELECT g.symbol, g.date, p.close FROM grid g ASOF JOIN prices p ON g.symbol=p.symbol AND g.date>=p.date),
    rt AS (SELECT symbol, date, ln(close/lag(close,20) OVER w) AS z0, ln(lead(close,20) OVER w/close) AS act FROM al """ + windows() + "), zz AS (SELECT symbol, date, act, " + zscore("z0") + " AS z FROM rt " + windows(252) + """),
    p0 AS (SELECT 'momentum' AS strategy, symbol, date, round(z*0.01,8)+0.0 AS pred, round(act,8)+0.0 AS actual FROM zz WHERE z IS NOT NULL AND act IS NOT NULL),
    predictions AS (SELECT * FROM (SELECT strategy, symbol, date, pred, lead(actual) OVER (PARTITION BY strategy, symbol ORDER BY date) AS actual FROM p0) WHERE actual IS NOT NULL), """ + signals_sql() + ", " + ledger_sql() + ", " + perf_sql()


@query("E0_momentum_backtest", E0_SQL + " SELECT strategy, symbol, n_trades, total_days, " + cols(*PERF_COLUMNS, digits=4) + " FROM perf")
def e0(spark, sf):
    perf = flows.momentum_backtest(driver.prices(spark, sf))
    return out(perf, "strategy symbol n_trades total_days", 4, **{c: c for c in PERF_COLUMNS})


def _failed_sql():
    rules = [f"CASE WHEN coalesce({n}{op}{limit},false) THEN NULL ELSE '{n}{op}{limit:g}' END" for n, op, limit in fc.GATE_RULES]
    return "concat_ws(';', " + ", ".join(rules) + ")"


E1_SQL = RIDGE_SQL + ", " + METRICS_SQL.replace("y AS (SELECT *, CAST(year(date)-1995 AS INTEGER) AS fold FROM predictions)", "y2 AS (SELECT * FROM oof)").replace("FROM y)", "FROM y2)") + ", sm AS (SELECT symbol, " + ", ".join(
    f"round(avg({m}),9) AS {m}_mean, round(stddev_pop({m}),9) AS {m}_std, round(min({m}),9) AS {m}_min" for m in NAMES) + ", CAST(arg_min(fold, (-round(dir_acc,9), fold)) AS INTEGER) AS best_fold, count(*) AS n_folds FROM mt GROUP BY 1)"


@query("E1_train_evaluate", E1_SQL + f" SELECT symbol, n_folds, best_fold, {_failed_sql()}='' AS passes, {_failed_sql()} AS failed, " + cols("ic_mean", digits=5) + " FROM sm")
def e1(spark, sf):
    _, summary = flows.train_evaluate(two_feature_folds(spark, sf), TWO)
    return summary.select("symbol", "n_folds", "best_fold", "passes", F.concat_ws(";", "failed").alias("failed"), r("ic_mean", 5).alias("ic_mean"))


LAGGED_SQL = BENCH + ", lagged AS (SELECT * FROM (SELECT strategy, symbol, date, pred, lead(actual) OVER (PARTITION BY strategy, symbol ORDER BY date) AS actual FROM predictions) WHERE actual IS NOT NULL), " + signals_sql("lagged") + ", " + ledger_sql() + ", " + perf_sql()


@query("E2_backtest_report", LAGGED_SQL + " SELECT strategy, symbol, " + rnd("total_return_pct-bh_total_return_pct", "alpha_pct", 5) + ", " + cols("sharpe", "max_drawdown_pct", digits=5) + " FROM perf JOIN bp USING (symbol)")
def e2(spark, sf):
    report = flows.backtest_report(driver.predictions(spark, sf), driver.prices(spark, sf), partitions=driver.tasks(spark, sf))
    return report.select("strategy", "symbol", r("alpha_pct", 5).alias("alpha_pct"), r("sharpe", 5).alias("sharpe"), r("max_drawdown_pct", 5).alias("max_drawdown_pct"))


# The trades of the honest report: cash and longs only, on out-of-fold days.
E2_SQL = PERM_SQL + """,
    cl2 AS (SELECT * FROM cd WHERE is_oof AND date IN (SELECT date FROM predictions p WHERE p.symbol=cd.symbol AND p.pred>=0.008 AND p.is_oof)),
    nl AS MATERIALIZED (SELECT c.symbol, c.date, d.date AS nxt FROM cf c ASOF JOIN cl2 d ON d.symbol=c.symbol AND c.free<=d.date WHERE c.is_oof),
    wl AS (SELECT symbol, min(date) AS date FROM cl2 GROUP BY 1 UNION ALL SELECT wl.symbol, nl.nxt FROM wl JOIN nl ON nl.symbol=wl.symbol AND nl.date=wl.date),
    tk AS (SELECT symbol, count(*) AS n_trades, avg(ret) AS m, stddev_pop(ret) AS sd FROM wl JOIN cl2 USING (symbol, date) GROUP BY 1),
    hn AS (SELECT strategy, symbol, corr(pred,actual) AS ic, greatest((max(date)-min(date))/365.25,0.01) AS years FROM predictions WHERE is_oof GROUP BY 1,2 HAVING count(*)>=5)"""


@query("E2_validation_report", E2_SQL + " SELECT hn.strategy, symbol, n_trades, verdict, " + rnd("CASE WHEN sd>0 THEN m/sd*sqrt(greatest(n_trades/years,1)) ELSE 0 END", "sharpe", 5) + ", " + rnd("coalesce(CASE WHEN NOT isnan(ic) THEN ic END,0)", "ic", 5)
       + " FROM hn JOIN tk USING (symbol) LEFT JOIN (SELECT symbol, verdict FROM vd) USING (symbol) WHERE n_trades>=2")
def e2_validation(spark, sf):
    v = flows.validation_report(driver.predictions(spark, sf))
    return v.select("strategy", "symbol", "n_trades", "verdict", r("sharpe", 5).alias("sharpe"), r("ic", 5).alias("ic"))


@query("E3_rotation_report", ORACLES["R4_yearly"])
def e3_rotation(spark, sf):
    y = flows.rotation_report(sleeves(spark, sf), primary_prices(spark, sf))
    return out(y, "book year", 5, **{c: c for c in ("primary_long_pct", "invested_pct", "bh_ret_pct", "rotation_ret_pct", "primary_ret_pct")})


@query("E4_diversifier_report", ORACLES["X4_top_k"])
def e4(spark, sf):
    best = flows.diversifier_report(screen_panel(spark, sf), "AF", min_dollar_volume=FLOOR)
    return out(best, "symbol regime rank", 5, value="value")


LIVE_SQL = FOLD + """, b AS (SELECT * FROM (SELECT symbol, date, n_folds, round(ensemble,9) AS ensemble, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn FROM en) WHERE rn<=60),
    c AS (SELECT *, (rank() OVER (PARTITION BY symbol ORDER BY abs(ensemble))-1)/count(*) OVER (PARTITION BY symbol) AS conf_pct FROM b) SELECT symbol, date, CASE WHEN ensemble>0 THEN 'BULLISH' ELSE 'BEARISH' END AS direction, n_folds, """ + cols("ensemble", "conf_pct") + """,
    CASE WHEN abs(ensemble)>=0.008 AND ensemble>0 THEN (CASE WHEN conf_pct<0.25 THEN 0.25 WHEN conf_pct<0.5 THEN 0.5 WHEN conf_pct<0.75 THEN 0.75 ELSE 1.0 END) ELSE 0.0 END::DOUBLE AS position FROM c"""


@query("E3_live_signals", LIVE_SQL)
def e3(spark, sf):
    folds = driver.fold_predictions(spark, sf)
    quality = folds.groupBy("symbol", "fold").agg(F.max("dir_acc").alias("dir_acc"), F.max("ic").alias("ic"))
    live = flows.live_signals(folds.select("symbol", "date", "fold", "pred"), quality)
    return live.select("symbol", "date", "direction", "n_folds", r("ensemble").alias("ensemble"), r("conf_pct").alias("conf_pct"), "position")
