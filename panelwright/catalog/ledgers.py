"""Signals G1-G8, ledgers L1-L15, validation V1-V6."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import r
from ..operators import ledger as led

from ..operators import signals as sig
from ..operators import validation as val
from ..sources import driver
from .base import BDAYS_SQL, PERF_COLUMNS, cols, ledger_sql, out, perf_sql, predictions_sql, query, rnd, signals_sql

PRED = "WITH " + predictions_sql()
SIG = PRED + ", " + signals_sql()
LED = SIG + ", " + ledger_sql()
PERF = LED + ", " + perf_sql()
KEYS = "strategy symbol date"
SEL = " SELECT strategy, symbol, date, "


def preds(spark, sf):
    return driver.predictions(spark, sf)


def signals(spark, sf):
    return sig.build_signals(preds(spark, sf))


def ledger(spark, sf):
    return led.ledger(signals(spark, sf))


@query("G1_confidence_whole", SIG + SEL + rnd("conf_pct", "conf_pct") + " FROM ranked")
def g1(spark, sf):
    return out(sig.confidence(preds(spark, sf)), KEYS, conf_pct="conf_pct")


@query("G1_confidence_batch", PRED + SEL + rnd("(rank() OVER (PARTITION BY strategy, symbol ORDER BY abs(pred))-1)/count(*) OVER (PARTITION BY strategy, symbol)", "conf_pct") + " FROM predictions")
def g1_batch(spark, sf):
    return out(sig.confidence(preds(spark, sf), "batch"), KEYS, conf_pct="conf_pct")


@query("G1_confidence_trailing", PRED + ", l AS (SELECT *, abs(pred) AS x, list(abs(pred)) OVER (PARTITION BY strategy, symbol ORDER BY date ROWS BETWEEN 125 PRECEDING AND CURRENT ROW) AS v FROM predictions)" + SEL
       + rnd("(len(list_filter(v, lambda y: y<x))+(len(list_filter(v, lambda y: y=x))+1)/2.0)/len(v)", "conf_pct") + " FROM l")
def g1_trailing(spark, sf):
    return out(sig.confidence(preds(spark, sf), "trailing", window=126), KEYS, conf_pct="conf_pct")


@query("G1_confidence_expanding", PRED + ", l AS (SELECT *, abs(pred) AS x, list(abs(pred)) OVER (PARTITION BY strategy, symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM predictions)" + SEL
       + rnd("(len(list_filter(v, lambda y: y<x))+(len(list_filter(v, lambda y: y=x))+1)/2.0)/len(v)", "conf_pct") + " FROM l")
def g1_expanding(spark, sf):
    return out(sig.confidence(preds(spark, sf), "expanding"), KEYS, conf_pct="conf_pct")


@query("G1_confidence_oof", PRED + ", c AS (SELECT p.strategy, p.symbol, p.date, count(o.pred) FILTER (WHERE abs(o.pred)<abs(p.pred)) AS k, count(o.pred) AS n FROM predictions p LEFT JOIN (SELECT * FROM predictions WHERE is_oof) o ON o.strategy=p.strategy AND o.symbol=p.symbol GROUP BY 1,2,3)"
       + SEL + rnd("coalesce(k*1.0/nullif(n,0),0.5)", "conf_pct") + " FROM c")
def g1_oof(spark, sf):
    p = preds(spark, sf)
    return out(sig.confidence_against(p, p.filter("is_oof"), partitions=driver.tasks(spark, sf)), KEYS, conf_pct="conf_pct")


@query("G2_tier_size", SIG + SEL + rnd("CASE WHEN conf_pct<0.25 THEN 0.25 WHEN conf_pct<0.5 THEN 0.5 WHEN conf_pct<0.75 THEN 0.75 ELSE 1.0 END", "size") + " FROM ranked")
def g2(spark, sf):
    return out(sig.confidence(preds(spark, sf)), KEYS, size=sig.tier_size("conf_pct"))


@query("G3_direction", PRED + SEL + "CASE WHEN abs(pred)<0.008 THEN 0 ELSE CAST(sign(pred) AS INTEGER) END AS direction FROM predictions")
def g3(spark, sf):
    return preds(spark, sf).select(*KEYS.split(), sig.direction("pred", 0.008).alias("direction"))


@query("G4_modes", PRED + ", " + signals_sql(mode="'long_short'") + ", " + signals_sql(mode="'cash_bonds'").replace("ranked AS", "ranked2 AS").replace("FROM ranked)", "FROM ranked2)").replace("directed AS", "directed2 AS").replace("FROM directed)", "FROM directed2)").replace("moded AS", "moded2 AS").replace("FROM moded)", "FROM moded2)").replace("sized AS", "sized2 AS").replace("FROM sized)", "FROM sized2)").replace("signals AS", "signals2 AS")
       + " SELECT a.strategy, a.symbol, a.date, a.position AS long_short, b.position AS cash_bonds FROM signals a JOIN signals2 b USING (strategy, symbol, date)")
def g4(spark, sf):
    both = sig.build_signals(preds(spark, sf), mode="long_short").withColumnRenamed("position", "long_short")
    bonds = sig.build_signals(both, mode="cash_bonds", conf_mode=None)
    return bonds.select(*KEYS.split(), "long_short", F.col("position").alias("cash_bonds"))


@query("G5_exec_lag", PRED + " SELECT * FROM (SELECT strategy, symbol, date, pred, lead(actual,1) OVER (PARTITION BY strategy, symbol ORDER BY date) AS actual FROM predictions) WHERE actual IS NOT NULL")
def g5(spark, sf):
    return sig.exec_lag(preds(spark, sf), 1).select(*KEYS.split(), "pred", "actual")


@query("G6_decide", PRED + """, last AS (SELECT symbol, max(date) AS date, arg_max(pred,date) AS ensemble, count(*) FILTER (WHERE pred>0)*1.0/count(*) AS agreement, 0.0 AS z FROM predictions GROUP BY 1),
    c AS (SELECT l.symbol, l.date, l.ensemble, l.agreement, coalesce((SELECT avg(CASE WHEN abs(o.pred)<abs(l.ensemble) THEN 1.0 ELSE 0.0 END) FROM predictions o WHERE o.symbol=l.symbol AND o.is_oof),0.5) AS conf_pct,
    (SELECT stddev_samp(r)*sqrt(252)*100 FROM (SELECT ln(close/lag(close) OVER (ORDER BY date)) AS r, date, row_number() OVER (ORDER BY date DESC) AS rn FROM prices p WHERE p.symbol=l.symbol) WHERE rn<=20) AS rv FROM last l)
    SELECT symbol, date, CASE WHEN abs(ensemble)>=0.008 AND ensemble>0 THEN 'BUY' ELSE 'HOLD CASH' END AS action,
    CAST(CASE WHEN abs(ensemble)>=0.008 AND ensemble>0 THEN (CASE WHEN conf_pct<0.25 THEN 0.25 WHEN conf_pct<0.5 THEN 0.5 WHEN conf_pct<0.75 THEN 0.75 ELSE 1 END) ELSE 0 END AS DOUBLE) AS position,
    CASE WHEN abs(ensemble)<0.008 THEN 'signal below minimum threshold' ELSE 'confidence and agreement' END AS reason, rv<12 AS vol_warning, """ + rnd("conf_pct", "conf_pct") + " FROM c")
def g6(spark, sf):
    from ..functions import indicators as ind

    p = preds(spark, sf)
    last = p.groupBy("symbol").agg(
        F.max("date").alias("date"), F.max_by("pred", "date").alias("ensemble"), (F.count_if(F.col("pred") > 0) / F.count(F.lit(1))).alias("agreement")
    )
    vol = driver.prices(spark, sf).withColumn("r1", ind.log_return("close"))
    vol = vol.withColumn("realised_vol", ind.rolling_vol("r1", 20) * 100).groupBy("symbol").agg(F.max_by("realised_vol", "date").alias("realised_vol"))
    ranked = sig.confidence_against(last, p.filter("is_oof"), ["symbol"], "ensemble").join(vol, "symbol")
    return sig.decide(ranked).select("symbol", "date", "action", "position", "reason", "vol_warning", r("conf_pct").alias("conf_pct"))


@query("G7_conviction", SIG + SEL + """CASE WHEN 1-conf_pct>=0.75 AND conf_pct>=0.60 THEN 'HIGH' WHEN 1-conf_pct>=0.60 AND conf_pct>=0.40 THEN 'MODERATE' WHEN 1-conf_pct>=0.50 THEN 'LOW' ELSE 'MIXED' END AS both_label,
    CASE WHEN conf_pct>=0.70 THEN 'HIGH' WHEN conf_pct>=0.45 THEN 'MODERATE' WHEN conf_pct>=0.25 THEN 'LOW' ELSE 'WEAK' END AS conf_label FROM ranked""")
def g7(spark, sf):
    ranked = sig.confidence(preds(spark, sf))
    return ranked.select(*KEYS.split(), sig.conviction(1 - F.col("conf_pct"), "conf_pct").alias("both_label"), sig.conviction_of_confidence("conf_pct").alias("conf_label"))


@query("G8_trend_floor", SIG + """, m AS (SELECT symbol, date, coalesce(round(close-(CASE WHEN count(close) OVER w>=50 THEN avg(close) OVER w END),9)>0,false) AS above FROM prices WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))
    SELECT s.strategy, s.symbol, s.date, CAST(CASE WHEN m.above AND raw_direction<0 THEN greatest(position,0.1) ELSE position END AS DOUBLE) AS position FROM signals s JOIN m USING (symbol, date)""")
def g8(spark, sf):
    above = led.above_average(driver.prices(spark, sf), 50).select("symbol", "date", "above_ma")
    df = signals(spark, sf).join(above, ["symbol", "date"])
    return df.select(*KEYS.split(), sig.trend_floor("position", "raw_direction", "above_ma", 0.10).alias("position"))


TRADES = LED + """, tr AS (SELECT *, coalesce(lag(position) OVER (PARTITION BY strategy, symbol ORDER BY date),0) AS old_pos, coalesce(lag(capital) OVER (PARTITION BY strategy, symbol ORDER BY date),100000) AS before FROM ledger)"""


@query("L1_trades", TRADES + """, ag AS (SELECT *, rn-coalesce(max(CASE WHEN abs(position-old_pos)>1e-6 THEN rn END) OVER (PARTITION BY strategy, symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),1) AS age
    FROM (SELECT *, row_number() OVER (PARTITION BY strategy, symbol ORDER BY date) AS rn FROM tr))""" + SEL + """CAST(old_pos AS DOUBLE) AS old_pos, position AS new_pos, CASE WHEN old_pos=0 THEN 'BUY' WHEN position=0 THEN 'SELL' WHEN position>old_pos THEN 'ADD' ELSE 'TRIM' END AS trade,
    CASE WHEN age>=10 THEN 'weekly' WHEN old_pos=0 THEN 'entering' WHEN position=0 THEN 'exiting' ELSE 'size_chg' END AS reason, CASE WHEN position=0 THEN 'flat' WHEN conf_pct>=0.75 THEN 'top quartile' WHEN conf_pct>=0.5 THEN 'third quartile' WHEN conf_pct>=0.25 THEN 'second quartile' ELSE 'bottom quartile' END AS size_reason,
    """ + rnd("abs(position-old_pos)*0.0015*before", "cost", 4) + ", " + rnd("before*position", "stock_value", 2) + " FROM ag WHERE abs(position-old_pos)>1e-6")
def l1(spark, sf):
    t = led.trades(ledger(spark, sf))
    return t.select(*KEYS.split(), "old_pos", "new_pos", "trade", "reason", "size_reason", r("cost", 4).alias("cost"), r("stock_value", 2).alias("stock_value"))


@query("L2_ledger", LED + SEL + "position, " + cols("ret_gross", "ret_net") + ", " + rnd("ln(capital)", "log_capital") + " FROM ledger")
def l2(spark, sf):
    return out(ledger(spark, sf), KEYS + " position", ret_gross="ret_gross", ret_net="ret_net", log_capital="log_capital")


@query("L3_days_held", SIG + """, c AS (SELECT *, CASE WHEN position<>coalesce(lag(position) OVER w,0) THEN 1 ELSE 0 END AS ch FROM signals WINDOW w AS (PARTITION BY strategy, symbol ORDER BY date)),
    d AS (SELECT *, sum(ch) OVER (PARTITION BY strategy, symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM c)""" + SEL + "row_number() OVER (PARTITION BY strategy, symbol, run ORDER BY date) AS days_held FROM d")
def l3(spark, sf):
    return led.days_held(signals(spark, sf)).select(*KEYS.split(), "days_held")


@query("L5_perf", PERF + " SELECT strategy, symbol, n_trades, total_days, " + cols(*PERF_COLUMNS, digits=5) + " FROM perf")
def l5(spark, sf):
    return out(led.perf(ledger(spark, sf)), "strategy symbol n_trades total_days", 5, **{c: c for c in PERF_COLUMNS})


@query("L5_perf_daily", LED + """, x AS (SELECT *, capital/lag(capital) OVER (PARTITION BY symbol ORDER BY date)-1 AS rr, capital/max(capital) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)-1 AS dd FROM ledger)
    SELECT symbol, """ + rnd("(arg_max(capital,date)/arg_min(capital,date)-1)*100", "total_return_pct", 5) + ", " + rnd("(pow(arg_max(capital,date)/arg_min(capital,date),252.0/count(*))-1)*100", "annual_return_pct", 5)
       + ", " + rnd("stddev_samp(rr)*sqrt(252)*100", "volatility_pct", 5) + ", " + rnd("CASE WHEN stddev_samp(rr)>0 THEN avg(rr)/stddev_samp(rr)*sqrt(252) ELSE 0 END", "sharpe", 5) + ", " + rnd("min(dd)*100", "max_drawdown_pct", 5) + " FROM x GROUP BY 1")
def l5_daily(spark, sf):
    return out(led.perf_daily(ledger(spark, sf), ["symbol"]), "symbol", 5, total_return_pct="total_return_pct", annual_return_pct="annual_return_pct", volatility_pct="volatility_pct", sharpe="sharpe", max_drawdown_pct="max_drawdown_pct")


@query("L6_drawdown", LED + SEL + rnd("capital/max(capital) OVER (PARTITION BY strategy, symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)-1", "drawdown") + " FROM ledger")
def l6(spark, sf):
    return out(led.drawdown(ledger(spark, sf)), KEYS, drawdown="drawdown")


BENCH = PRED + """, bd AS (SELECT DISTINCT symbol, date FROM predictions), al AS (SELECT b.symbol, b.date, p.close FROM bd b ASOF LEFT JOIN prices p ON b.symbol=p.symbol AND b.date>=p.date),
    be AS (SELECT symbol, date, close/first_value(close) OVER (PARTITION BY symbol ORDER BY date)*100000 AS capital FROM al),
    br AS (SELECT *, ln(capital/lag(capital) OVER (PARTITION BY symbol ORDER BY date)) AS ret, capital/max(capital) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)-1 AS dd FROM be),
    bp AS (SELECT symbol, (arg_max(capital,date)/arg_min(capital,date)-1)*100 AS bh_total_return_pct, (exp(ln(arg_max(capital,date)/arg_min(capital,date))/greatest(date_diff('day',min(date),max(date))/365.25,0.01))-1)*100 AS bh_annual_return_pct,
    coalesce(avg(ret)/(stddev_pop(ret)+1e-9)*sqrt(252),0) AS bh_sharpe, min(dd)*100 AS bh_max_drawdown_pct FROM br GROUP BY 1)"""
BENCH_COLUMNS = ("bh_total_return_pct", "bh_annual_return_pct", "bh_sharpe", "bh_max_drawdown_pct")


def bench(spark, sf):
    return led.benchmark(driver.prices(spark, sf).drop("volume"), preds(spark, sf), partitions=driver.tasks(spark, sf))


@query("L7_benchmark", BENCH + " SELECT symbol, " + cols(*BENCH_COLUMNS, digits=5) + " FROM bp")
def l7(spark, sf):
    return out(led.benchmark_perf(bench(spark, sf)), "symbol", 5, **{c: c for c in BENCH_COLUMNS})


@query("L7_benchmark_equity", BENCH + " SELECT symbol, date, " + rnd("ln(capital)", "log_capital") + " FROM be")
def l7_equity(spark, sf):
    return out(bench(spark, sf), "symbol date", log_capital=F.ln("capital"))


@query("L7_benchmark_from_returns", PRED + SEL + rnd("exp(sum(actual/20) OVER (PARTITION BY strategy, symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))", "growth") + " FROM predictions")
def l7_returns(spark, sf):
    return out(led.benchmark_from_returns(preds(spark, sf)), KEYS, growth=F.col("capital") / led.CAPITAL)


@query("L8_alpha", BENCH + ", " + signals_sql() + ", " + ledger_sql() + ", " + perf_sql() + " SELECT symbol, " + rnd("total_return_pct-bh_total_return_pct", "alpha_pct", 5) + ", " + rnd("annual_return_pct-bh_annual_return_pct", "alpha_annual_pct", 5) + " FROM perf JOIN bp USING (symbol)")
def l8(spark, sf):
    a = led.alpha(led.perf(ledger(spark, sf)), led.benchmark_perf(bench(spark, sf)))
    return out(a, "symbol", 5, alpha_pct="alpha_pct", alpha_annual_pct="alpha_annual_pct")


CFG = ", cfg AS (SELECT * FROM (VALUES " + ", ".join(f"('{c[0]}', {float(c[1])}::DOUBLE, {c[2]}::DOUBLE, '{c[3]}', {c[4]}::DOUBLE)" for c in led.CONFIGS) + ") t(config, max_pos, min_signal, mode, tc)), grid AS (SELECT * FROM predictions, cfg)"


@query("L9_sweep", PRED + CFG + ", " + signals_sql("grid", "min_signal", "mode", "max_pos", "config, strategy, symbol") + ", " + ledger_sql(keys="config, strategy, symbol", cost="(tc+0.0005)", mode="mode") + ", " + perf_sql("config, strategy, symbol")
       + " SELECT config, strategy, symbol, n_trades, total_days, " + cols(*PERF_COLUMNS, digits=5) + " FROM perf")
def l9(spark, sf):
    """The ten shipped configurations without stops and overlays: one window query."""
    grid = [(*c[:5], None, "off", 0.0) for c in led.CONFIGS]
    return out(led.sweep(driver.predictions(spark, sf, times=len(grid)), grid), "config strategy symbol n_trades total_days", 5, **{c: c for c in PERF_COLUMNS})


@query("L10_transitions", SIG + ", t AS (SELECT *, coalesce(lag(position) OVER (PARTITION BY strategy, symbol ORDER BY date),0) AS prev FROM signals)" + SEL + "CASE WHEN prev<=0 THEN 'entry' ELSE 'exit' END AS marker FROM t WHERE (prev<=0 AND position>0) OR (prev>0 AND position<=0)")
def l10(spark, sf):
    return led.transitions(signals(spark, sf)).select(*KEYS.split(), "marker")


@query("L11_conf_bins", SIG + " SELECT * FROM (SELECT strategy, symbol, CAST(least(floor(conf_pct*10),9) AS INTEGER) AS bin, count(*) AS n, " + rnd("avg(actual)", "mean_value") + " FROM signals GROUP BY 1,2,3) WHERE n>2")
def l11(spark, sf):
    return out(led.conf_bins(signals(spark, sf)), "strategy symbol bin n", mean_value="mean_value")


@query("L12_ret_hist", PRED + """, q AS (SELECT strategy, symbol, quantile_cont(actual,0.01) AS lo, quantile_cont(actual,0.99) AS hi FROM predictions GROUP BY 1,2)
    SELECT p.strategy, p.symbol, CAST(coalesce(least(floor((actual-lo)/((hi-lo)/40)),39),0) AS INTEGER) AS bin, count(*) AS n FROM predictions p JOIN q USING (strategy, symbol) WHERE actual BETWEEN lo AND hi GROUP BY 1,2,3""")
def l12(spark, sf):
    return led.ret_hist(preds(spark, sf))


@query("L13_cum_signal", PRED + SEL + rnd("exp(sum(sign(pred)*actual) OVER u)", "growth_strategy") + ", " + rnd("exp(sum(actual) OVER u)", "growth_long") + " FROM predictions WINDOW u AS (PARTITION BY strategy, symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def l13(spark, sf):
    return out(led.cum_signal(preds(spark, sf)), KEYS, growth_strategy=F.exp("cum_strategy"), growth_long=F.exp("cum_long"))


@query("L14_extend_ledger", LED + """, la AS (SELECT symbol, max(date) AS d, arg_max(capital,date) AS cap, arg_max(position,date) AS pos FROM ledger GROUP BY 1),
    nw AS (SELECT p.symbol, p.date, la.pos, la.cap, p.ret FROM (SELECT *, close/lag(close) OVER (PARTITION BY symbol ORDER BY date)-1 AS ret FROM prices) p JOIN la ON la.symbol=p.symbol AND p.date>la.d)
, al AS (SELECT symbol, date, pos AS position, true AS extended, """ + rnd("ln(cap)+sum(ln((1+CASE WHEN pos>0 THEN ret*pos ELSE 0 END)*(1+(1-pos)*0.05/252))) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", "log_capital") + " FROM nw) SELECT * FROM al UNION ALL SELECT symbol, date, position, false, " + rnd("ln(capital)", "log_capital") + " FROM ledger")
def l14(spark, sf):
    ext = led.extend_ledger(ledger(spark, sf), driver.prices(spark, sf), cash_rate=0.05)
    return out(ext, "symbol date position extended", log_capital=F.ln("capital"))


@query("L15_portfolio_summary", TRADES + """, mv AS (SELECT symbol, max(date) AS last_date, coalesce(min(CASE WHEN abs(position-old_pos)>1e-6 THEN date END),min(date)) AS first_trade, count(*) FILTER (WHERE abs(position-old_pos)>1e-6) AS n_trades,
    arg_max(capital,date) AS value, arg_max(position,date) AS position FROM tr GROUP BY 1),
    qt AS (SELECT p.symbol, arg_max(close,date) AS last_close, arg_min(close,date) FILTER (WHERE date>=first_trade) AS first_close FROM prices p JOIN mv USING (symbol) GROUP BY 1)
    SELECT symbol, last_date, first_trade, n_trades, position, """ + rnd("(value/100000-1)*100", "total_return_pct", 5) + ", " + rnd("(exp(ln(greatest(value,1)/100000)/greatest(date_diff('day',first_trade,last_date)/365.25,0.01))-1)*100", "annual_return_pct", 5)
       + ", " + rnd("(last_close/first_close-1)*100", "bh_return_pct", 5) + ", " + rnd("value*position/(last_close+1e-9)", "shares", 4) + " FROM mv JOIN qt USING (symbol)")
def l15(spark, sf):
    s = led.portfolio_summary(ledger(spark, sf), driver.prices(spark, sf))
    return s.select(
        "symbol", "last_date", "first_trade", "n_trades", "position", *[r(c, 5).alias(c) for c in ("total_return_pct", "annual_return_pct", "bh_return_pct")],
        r("shares", 4).alias("shares"),
    )


OOF = PRED + ", oof AS (SELECT * FROM predictions WHERE is_oof)"
BLOCKS = OOF + """, bl AS (SELECT *, sum(CASE WHEN date-prev>30 THEN 1 ELSE 0 END) OVER (PARTITION BY strategy, symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS block
    FROM (SELECT *, lag(date) OVER (PARTITION BY strategy, symbol ORDER BY date) AS prev FROM oof))"""


@query("V1_blocks", BLOCKS + ' SELECT strategy, symbol, CAST(block AS BIGINT) AS block, min(date) AS start, max(date) AS "end", count(*) AS n FROM bl GROUP BY 1,2,3')
def v1(spark, sf):
    return val.block_table(preds(spark, sf).filter("is_oof"))


PRED_ALL = "WITH RECURSIVE " + predictions_sql()
WALK = PRED_ALL + ", " + BDAYS_SQL + """, cand AS (SELECT p.*, max(b.idx) AS idx FROM predictions p JOIN bdays b ON b.date<=p.date AND b.date>p.date-3 WHERE is_oof AND abs(pred)>=0.008 AND pred>0 GROUP BY ALL),
    cf AS (SELECT c.*, b.date AS free FROM cand c JOIN bdays b ON b.idx=c.idx+20),
    nx AS (SELECT c.symbol, c.date, (SELECT min(d.date) FROM cand d WHERE d.symbol=c.symbol AND d.date>=c.free) AS nxt FROM cf c),
    wk AS (SELECT symbol, min(date) AS date FROM cand GROUP BY 1 UNION ALL SELECT wk.symbol, nx.nxt FROM wk JOIN nx ON nx.symbol=wk.symbol AND nx.date=wk.date WHERE nx.nxt IS NOT NULL),
    taken AS (SELECT c.strategy, c.symbol, c.date, c.pred, c.actual FROM cand c JOIN wk ON wk.symbol=c.symbol AND wk.date=c.date)"""


@query("V2_non_overlapping", WALK + " SELECT strategy, symbol, date, actual AS trade_ret FROM taken")
def v2(spark, sf):
    p = preds(spark, sf).filter("is_oof")
    return val.non_overlapping(p).select(*KEYS.split(), "trade_ret")


@query("V3_oof_validation", WALK + """, b AS (SELECT symbol, count(*) AS n_predictions, min(date) AS lo, max(date) AS hi, corr(pred,actual) AS ic FROM predictions WHERE is_oof GROUP BY 1),
    e AS (SELECT *, sum(actual) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS eq FROM taken),
    d AS (SELECT *, exp(eq-greatest(0,max(eq) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)))-1 AS dd FROM e),
    t AS (SELECT symbol, count(*) AS n_trades, sum(actual) AS lg, avg(actual) AS m, stddev_pop(actual) AS sd, min(dd) AS dd, avg(CASE WHEN actual>0 THEN 1.0 ELSE 0.0 END) AS win_rate FROM d GROUP BY 1),
    j AS (SELECT *, greatest((hi-lo)/365.25,0.01) AS years FROM b JOIN t USING (symbol) WHERE n_trades>=2 AND n_predictions>=5)
    SELECT symbol, n_predictions, n_trades, """ + cols("ic", "win_rate", digits=5) + ", " + rnd("(exp(lg)-1)*100", "total_return_pct", 5) + ", " + rnd("(exp(lg/years)-1)*100", "annual_return_pct", 5) + ", " + rnd("CASE WHEN sd>0 THEN m/sd*sqrt(greatest(n_trades/years,1)) ELSE 0 END", "sharpe", 5)
       + ", " + rnd("least(dd,0)*100", "max_drawdown_pct", 5) + ", " + rnd("n_trades/years", "trades_per_year", 5) + ", " + rnd("least(n_trades*20/greatest((hi-lo)*252/365.25,1),1)*100", "time_in_market_pct", 5) + " FROM j")
def v3(spark, sf):
    v = val.oof_validation(preds(spark, sf))
    names = ("ic", "win_rate", "total_return_pct", "annual_return_pct", "sharpe", "max_drawdown_pct", "trades_per_year", "time_in_market_pct")
    return out(v, "symbol n_predictions n_trades", 5, **{c: c for c in names})


N_BOOT, N_PERM, SEED, DRAWS = 300, 1000, 42, 9000
ON = "USING (strategy, symbol)"
# Draws are made up to DRAWS times; every key of the test tables is full well before.
CHUNKS_SQL = PRED_ALL + ", " + BDAYS_SQL + BLOCKS.removeprefix(PRED) + f""",
    bt AS (SELECT strategy, symbol, block, min(date) AS s, max(date) AS e, count(*) AS n FROM bl GROUP BY 1,2,3),
    sz AS (SELECT strategy, symbol, CAST(floor(median(n)) AS BIGINT) AS len FROM bt GROUP BY 1,2 HAVING count(*)>=4 AND sum(n)>=30),
    mk AS (SELECT strategy, symbol, date, false AS is_row, 1 AS st, 0 AS en FROM (SELECT strategy, symbol, s AS date FROM bt) UNION ALL SELECT strategy, symbol, e, false, 0, 1 FROM bt
        UNION ALL SELECT strategy, symbol, date, true, 0, 0 FROM predictions WHERE NOT is_oof),
    cn AS (SELECT *, sum(st) OVER (PARTITION BY strategy, symbol ORDER BY date) AS started, coalesce(sum(en) OVER (PARTITION BY strategy, symbol ORDER BY date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING),0) AS ended FROM mk),
    fr AS (SELECT *, row_number() OVER (PARTITION BY strategy, symbol ORDER BY date)-1 AS pos FROM cn WHERE is_row),
    ky AS (SELECT strategy, symbol, any_value(len) AS len, count(*)-any_value(len) AS places FROM fr JOIN sz {ON} GROUP BY 1,2 HAVING count(*)>=any_value(len)+1),
    cl AS (SELECT a.strategy, a.symbol, a.pos AS id, a.date AS lo, b.date AS hi FROM fr a JOIN ky k {ON} JOIN fr b ON b.strategy=a.strategy AND b.symbol=a.symbol AND b.pos=a.pos+k.len-1 WHERE a.pos<k.places AND b.started=a.ended),
    ch AS (SELECT strategy, symbol, false AS is_oof, id, lo, hi FROM cl UNION ALL SELECT strategy, symbol, true, block, s, e FROM bt),
    cd AS (SELECT p.strategy, p.symbol, p.is_oof, p.date, sign(p.pred)*p.actual AS ret, max(b.idx) AS idx FROM predictions p JOIN bdays b ON b.date<=p.date AND b.date>p.date-3 WHERE abs(pred)>=0.008 GROUP BY ALL),
    cf AS (SELECT c.*, b.date AS free FROM cd c JOIN bdays b ON b.idx=c.idx+20),
    nx AS MATERIALIZED (SELECT c.strategy, c.symbol, c.is_oof, c.date, d.date AS nxt FROM cf c ASOF JOIN cd d ON d.strategy=c.strategy AND d.symbol=c.symbol AND d.is_oof=c.is_oof AND c.free<=d.date),
    c0 AS MATERIALIZED (SELECT ch.*, d.date FROM ch ASOF JOIN cd d ON d.strategy=ch.strategy AND d.symbol=ch.symbol AND d.is_oof=ch.is_oof AND ch.lo<=d.date),
    wk AS (SELECT * FROM c0 UNION ALL SELECT wk.strategy, wk.symbol, wk.is_oof, wk.id, wk.lo, wk.hi, nx.nxt FROM wk JOIN nx ON nx.strategy=wk.strategy AND nx.symbol=wk.symbol AND nx.is_oof=wk.is_oof AND nx.date=wk.date WHERE nx.nxt<=wk.hi),
    mt AS (SELECT strategy, symbol, is_oof, id, count(*) AS n_trades, avg(CASE WHEN ret>0 THEN 1.0 ELSE 0.0 END) AS win_rate, (exp(sum(ret))-1)*100 AS pct_return FROM wk JOIN cd USING (strategy, symbol, is_oof, date) WHERE date<=hi GROUP BY 1,2,3,4),
    ic AS (SELECT ch.strategy, ch.symbol, ch.is_oof, ch.id, coalesce(CASE WHEN NOT isnan(corr(pred,actual)) THEN corr(pred,actual) END,0) AS ic FROM ch JOIN predictions p ON p.strategy=ch.strategy AND p.symbol=ch.symbol AND p.is_oof=ch.is_oof AND p.date BETWEEN ch.lo AND ch.hi GROUP BY 1,2,3,4 HAVING count(*)>=5),
    sc AS (SELECT * FROM mt JOIN ic USING (strategy, symbol, is_oof, id)),
    dr AS (SELECT strategy, symbol, a AS attempt, ('0x'||substr(md5(concat_ws('|',strategy,symbol,a,{SEED})),1,15))::BIGINT%places AS id FROM ky, range({DRAWS}) t(a)),
    bs AS (SELECT sc.*, row_number() OVER (PARTITION BY strategy, symbol ORDER BY attempt) AS chunk FROM dr JOIN sc USING (strategy, symbol, id) WHERE NOT is_oof QUALIFY chunk<={N_BOOT}),
    sm AS (SELECT strategy, symbol, is_oof, CAST(id AS BIGINT) AS chunk, n_trades, ic, win_rate, pct_return, NULL::BIGINT AS shortfall FROM sc WHERE is_oof
        UNION ALL SELECT k.strategy, k.symbol, false, chunk, n_trades, ic, win_rate, pct_return, {N_BOOT}-count(chunk) OVER (PARTITION BY k.strategy, k.symbol) FROM ky k LEFT JOIN bs {ON})"""


@query("V4_bootstrap", CHUNKS_SQL + " SELECT strategy, symbol, is_oof, chunk, n_trades, CAST(shortfall AS BIGINT) AS shortfall, " + cols("ic", "win_rate", "pct_return") + " FROM sm")
def v4(spark, sf):
    return out(val.bootstrap(preds(spark, sf), N_BOOT, SEED), "strategy symbol chunk is_oof n_trades shortfall", ic="ic", win_rate="win_rate", pct_return="pct_return")


def _each(text: str) -> str:
    return ", ".join(text.format(m=m) for m in val.METRICS)


PERM_SQL = CHUNKS_SQL + f""",
    gp AS (SELECT strategy, symbol, count(*) FILTER (WHERE is_oof) AS n_oof, count(*) FILTER (WHERE NOT is_oof) AS n_boot, {_each("avg({m}) FILTER (WHERE is_oof) AS {m}_a, avg({m}) FILTER (WHERE NOT is_oof) AS {m}_b, sum({m}) AS {m}_t")}
        FROM sm WHERE chunk IS NOT NULL GROUP BY 1,2 HAVING n_oof>=3 AND n_boot>=30),
    rw AS (SELECT sm.*, n_oof, row_number() OVER (PARTITION BY strategy, symbol ORDER BY NOT is_oof, chunk)-1 AS i FROM sm JOIN gp {ON} WHERE chunk IS NOT NULL),
    hs AS (SELECT strategy, symbol, i, n_oof, b, md5(concat_ws('|',strategy,symbol,i,b,{SEED})) AS h FROM rw, range({-(-N_PERM // 4)}) t(b)),
    pm AS (SELECT strategy, symbol, b*4+q AS p, i FROM hs, range(4) u(q) WHERE b*4+q<{N_PERM} QUALIFY row_number() OVER (PARTITION BY strategy, symbol, b*4+q ORDER BY substr(h,CAST(1+8*q AS INTEGER),8), i)<=any_value(n_oof) OVER (PARTITION BY strategy, symbol, b*4+q)),
    sp AS (SELECT strategy, symbol, p, {_each("sum({m}) AS {m}_s")} FROM pm JOIN rw USING (strategy, symbol, i) GROUP BY 1,2,3),
    pp AS (SELECT strategy, symbol, {_each("count(*) FILTER (WHERE abs({m}_s/n_oof-({m}_t-{m}_s)/n_boot)>=abs({m}_a-{m}_b)-1e-9)/" + f"{float(N_PERM)}" + "::DOUBLE AS {m}_p")} FROM sp JOIN gp {ON} GROUP BY 1,2),
    pc AS (SELECT strategy, symbol, {_each("avg(CASE WHEN {m}<{m}_a-1e-9 THEN 100.0 ELSE 0.0 END) AS {m}_c")} FROM sm JOIN gp {ON} WHERE NOT is_oof AND chunk IS NOT NULL GROUP BY 1,2),
    vd AS (SELECT *, {"+".join(f"({m}_p<0.05)::BIGINT" for m in val.METRICS)} AS n_sig_flags, CASE n_sig_flags WHEN 0 THEN 'GENERALIZES' WHEN 1 THEN 'MARGINAL' ELSE 'OVERFIT' END AS verdict FROM gp JOIN pp {ON} JOIN pc {ON})"""


@query("V5_perm_test", PERM_SQL + " SELECT strategy, symbol, n_oof, n_boot, n_sig_flags, verdict, " + ", ".join(
    rnd(f"{m}_{c}", f"{m}_{n}") for m in val.METRICS for c, n in zip("abcp", ("oof_mean", "nonoof_mean", "oof_pctile", "perm_p"), strict=True)) + " FROM vd")
def v5(spark, sf):
    t = val.perm_test(val.bootstrap(preds(spark, sf), N_BOOT, SEED), N_PERM, SEED)
    return t.select("strategy", "symbol", "n_oof", "n_boot", "n_sig_flags", "verdict", *[r(f"{m}_{s}").alias(f"{m}_{s}") for m in val.METRICS for s in ("oof_mean", "nonoof_mean", "oof_pctile", "perm_p")])


@query("V6_sharpe_ratio", SIG + ", " + ledger_sql() + """, f AS (SELECT symbol, avg(ret_gross)/(stddev_pop(ret_gross)+1e-9)*sqrt(252) AS fs, avg(CASE WHEN is_oof THEN ret_gross END)/(stddev_pop(CASE WHEN is_oof THEN ret_gross END)+1e-9)*sqrt(252) AS os FROM ledger GROUP BY 1)
    SELECT symbol, """ + rnd("os/nullif(fs,0)", "sharpe_ratio", 4) + " FROM f WHERE os IS NOT NULL")
def v6(spark, sf):
    full = ledger(spark, sf)
    whole, oof = led.perf(full), led.perf(full.filter("is_oof"))
    return out(val.sharpe_ratio_check(oof, whole), "symbol", 4, sharpe_ratio="sharpe_ratio")
