"""Windowed indicators I1-I33 on the supplier panel, and the feature table F0."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ..functions import indicators as ind
from ..functions.expr import EPS, r, ratio
from ..operators import panel as pnl
from ..operators import screen as scr
from ..operators.order_stats import rank_so_far
from ..operators.rolling import rolling_z_all
from ..plans import features as feat
from ..sources import driver
from .base import (
    INTEREST_SQL, POSITIONS_SQL, cols, gated, out, prices_sql, query, rnd, windows, zscore,
)

PX = "WITH " + prices_sql()
KEY = "SELECT symbol, date, "


def px(spark, sf):
    return driver.prices(spark, sf)


def staged(df, *stages):
    for s in stages:
        df = df.withColumns(s)
    return df


def mean(c, n):
    return gated(f"avg({c})", c, n)


@query("I1_log_return", PX + KEY + ", ".join(rnd(f"ln(close/lag(close,{p}) OVER w)", f"r{p}") for p in (1, 3, 5, 10, 21)) + " FROM prices " + windows())
def i1(spark, sf):
    return out(px(spark, sf), "symbol date", **{f"r{p}": ind.log_return("close", p) for p in (1, 3, 5, 10, 21)})


@query("I2_forward_log_return", PX + KEY + rnd("ln(lead(close,20) OVER w/close)", "fwd20") + " FROM prices " + windows())
def i2(spark, sf):
    return out(px(spark, sf), "symbol date", fwd20=ind.forward_log_return("close", 20))


@query("I3_smoothed_target", PX + KEY + rnd("(" + "+".join(f"ln(lead(close,{h}) OVER w/close)" for h in (17, 18, 19, 20)) + ")/4", "target") + " FROM prices " + windows())
def i3(spark, sf):
    return out(px(spark, sf), "symbol date", target=ind.smoothed_target("close"))


@query("I4_simple_return", PX + KEY + rnd("close/lag(close) OVER w-1", "ret") + ", " + rnd("lead(close,10) OVER w/close-1", "fwd10") + " FROM prices " + windows())
def i4(spark, sf):
    return out(px(spark, sf), "symbol date", ret=ind.simple_return("close"), fwd10=ind.forward_simple_return("close", 10))


@query("I5_difference", PX + ", d AS (SELECT *, close-lag(close,5) OVER w AS d5 FROM prices " + windows() + ") " + KEY + cols("d5") + ", " + rnd("d5-lag(d5,5) OVER w", "dd5") + " FROM d " + windows())
def i5(spark, sf):
    return out(px(spark, sf), "symbol date", d5=ind.difference("close", 5), dd5=ind.second_difference("close", 5))


@query("I6_rolling_mean", PX + ", l AS (SELECT symbol, date, ln(close) AS lc FROM prices) " + KEY + ", ".join(rnd(mean("lc", n), f"ma{n}") for n in (20, 50, 200)) + " FROM l " + windows(20, 50, 200))
def i6(spark, sf):
    df = px(spark, sf).withColumn("lc", F.ln("close"))
    return out(df, "symbol date", **{f"ma{n}": ind.rolling_mean("lc", n) for n in (20, 50, 200)})


R1 = "r AS (SELECT *, ln(close/lag(close) OVER w) AS r1 FROM prices " + windows() + ")"


def vol(n):
    return f"({gated('stddev_samp(r1)', 'r1', n)})*sqrt(252)"


@query("I7_rolling_vol", PX + ", " + R1 + " " + KEY + ", ".join(rnd(vol(n), f"vol{n}") for n in (10, 20, 60)) + " FROM r " + windows(10, 20, 60))
def i7(spark, sf):
    df = px(spark, sf).withColumn("r1", ind.log_return("close"))
    return out(df, "symbol date", **{f"vol{n}": ind.rolling_vol("r1", n) for n in (10, 20, 60)})


@query("I8_rolling_z", PX + KEY + rnd(zscore("close"), "z", 5) + " FROM prices " + windows(252))
def i8(spark, sf):
    return out(px(spark, sf), "symbol date", 5, z=ind.rolling_z("close"))


@query("I8_rolling_z_wide", PX + ", " + R1 + " " + KEY + rnd(zscore("close"), "z_close", 5) + ", " + rnd(zscore("r1"), "z_r1", 5) + " FROM r " + windows(252))
def i8_wide(spark, sf):
    df = px(spark, sf).withColumn("r1", ind.log_return("close")).select("symbol", "date", "close", "r1")
    return out(rolling_z_all(df, ["close", "r1"]), "symbol date", 5, z_close="close", z_r1="r1")


@query("I9_rolling_sum_min", PX + KEY + rnd(gated("sum(volume)", "volume", 5), "sum5") + ", " + rnd(gated("min(close)", "close", 10), "min10") + " FROM prices " + windows(5, 10))
def i9(spark, sf):
    return out(px(spark, sf), "symbol date", sum5=ind.rolling_sum("volume", 5), min10=ind.rolling_min("close", 10))


VR = "v AS (SELECT *, ln(close/lag(close) OVER w) AS a, ln(volume/lag(volume) OVER w) AS b FROM prices " + windows() + ")"


def corr_sql(n):
    return f"CASE WHEN count(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 1 END) OVER w{n}>={n} THEN corr(a,b) OVER w{n} END"


@query("I10_rolling_corr", PX + ", " + VR + " " + KEY + ", ".join(rnd(corr_sql(n), f"corr{n}") for n in (10, 20)) + " FROM v " + windows(10, 20))
def i10(spark, sf):
    df = px(spark, sf).withColumns({"a": ind.log_return("close"), "b": ind.log_return("volume")})
    return out(df, "symbol date", **{f"corr{n}": ind.rolling_corr("a", "b", n) for n in (10, 20)})


@query("I11_rolling_pct_rank", PX + ", l AS (SELECT symbol, date, close, list(close) OVER w252 AS v FROM prices " + windows(252) + ") " + KEY + rnd(
    "CASE WHEN len(v)>=252 THEN (len(list_filter(v, lambda x: x<close))+(len(list_filter(v, lambda x: x=close))+1)/2.0)/len(v) END", "pct") + " FROM l")
def i11(spark, sf):
    return out(rank_so_far(px(spark, sf), {"pct": "close"}, 252, 252), "symbol date", pct="pct")


CHG = "c AS (SELECT *, close-lag(close) OVER w AS chg FROM prices " + windows() + ")"
GL = "g AS (SELECT *, CASE WHEN chg IS NOT NULL THEN greatest(chg,0) END AS up, CASE WHEN chg IS NOT NULL THEN -least(chg,0) END AS dn FROM c)"


@query("I12_rsi", PX + ", " + CHG + ", " + GL + " " + KEY + rnd(f"100-100/(1+({mean('up', 14)})/(({mean('dn', 14)})+1e-9))", "rsi14") + " FROM g " + windows(14))
def i12(spark, sf):
    df = px(spark, sf).withColumn("chg", ind.difference("close", 1))
    return out(df, "symbol date", rsi14=ind.rsi("chg", 14))


NUMBERED = "p AS (SELECT symbol, date, close, row_number() OVER w AS i FROM prices " + windows() + ")"


@query("I13_ema", PX.replace("WITH ", "WITH RECURSIVE ") + ", " + NUMBERED + """, e AS (SELECT symbol, date, i, close AS e12 FROM p WHERE i=1
    UNION ALL SELECT p.symbol, p.date, p.i, 2.0/13*p.close+(1-2.0/13)*e.e12 FROM e JOIN p ON p.symbol=e.symbol AND p.i=e.i+1) """ + KEY + cols("e12") + " FROM e")
def i13(spark, sf):
    return out(ind.ema_columns(px(spark, sf).select("symbol", "date", "close"), {"e12": ("close", 12)}), "symbol date", e12="e12")


@query("I14_macd", PX.replace("WITH ", "WITH RECURSIVE ") + ", " + NUMBERED + """, e AS (SELECT symbol, date, i, close AS f, close AS s, 0.0::DOUBLE AS g FROM p WHERE i=1
    UNION ALL SELECT symbol, date, i, f, s, 0.2*(f-s)+0.8*g0 FROM (SELECT p.symbol, p.date, p.i, 2.0/13*p.close+(1-2.0/13)*e.f AS f, 2.0/27*p.close+(1-2.0/27)*e.s AS s, e.g AS g0
    FROM e JOIN p ON p.symbol=e.symbol AND p.i=e.i+1)) """ + KEY + rnd("f-s-g", "macd_hist") + " FROM e")
def i14(spark, sf):
    return out(ind.macd(px(spark, sf).select("symbol", "date", "close")), "symbol date", macd_hist="macd_hist")


@query("I15_ma_distance", PX + ", m AS (SELECT *, " + f"{mean('close', 50)} AS m50, {mean('close', 200)} AS m200" + " FROM prices " + windows(50, 200) + ") " + KEY
       + rnd("close/m50-1", "dist50") + ", " + rnd("m50/(m200+1e-9)-1", "ma_cross") + ", " + rnd("m50/lag(m50,21) OVER w-1", "slope21") + " FROM m " + windows())
def i15(spark, sf):
    df = px(spark, sf).withColumns({"m50": ind.rolling_mean("close", 50), "m200": ind.rolling_mean("close", 200)})
    return out(df, "symbol date", dist50=ratio("close", "m50") - 1, ma_cross=F.col("m50") / (F.col("m200") + EPS) - 1, slope21=ind.simple_return("m50", 21))


@query("I16_rate_of_change", PX + KEY + ", ".join(rnd(f"close/lag(close,{p}) OVER w-1", f"roc{p}") for p in (5, 10, 20)) + " FROM prices " + windows())
def i16(spark, sf):
    return out(px(spark, sf), "symbol date", **{f"roc{p}": ind.simple_return("close", p) for p in (5, 10, 20)})


# Two suppliers' worth of series would leave most rows out; the partner of every supplier is the market as a
# whole: the mean close of all suppliers on that day, whose sum is rounded to the quotes' decimals so that both engines divide the same number.
MARKET = "mk AS (SELECT date, round(sum(close),4)/count(*) AS market FROM prices GROUP BY 1), pm AS (SELECT p.symbol, p.date, p.close, m.market FROM prices p JOIN mk m ON p.date=m.date)"


def with_market(spark, sf):
    """Panel beside the market series: aggregated map-side to one row per day and broadcast."""
    panel = px(spark, sf).select("symbol", "date", "close")
    market = panel.groupBy("date").agg((F.round(F.sum("close"), 4) / F.count(F.lit(1))).alias("market"))
    return panel.join(market, "date")


@query("I17_symbol_ratio", PX + ", " + MARKET + ", q AS (SELECT *, close/(market+1e-9) AS rel FROM pm) " + KEY + rnd("rel", "rel", 4) + ", " + rnd("ln(rel/lag(rel,5) OVER w)", "rel_mom5", 4) + " FROM q " + windows())
def i17(spark, sf):
    df = with_market(spark, sf).withColumn("rel", F.col("close") / (F.col("market") + EPS))
    return out(df, "symbol date", 4, rel="rel", rel_mom5=ind.log_return("rel", 5))


@query("I18_spread", PX + ", " + MARKET + ", q AS (SELECT *, close*42-market AS crack FROM pm) SELECT symbol, date, close-market AS spread, crack, "
       + rnd("ln(greatest(crack,1)/lag(greatest(crack,1),5) OVER w)", "crack_r5", 4) + " FROM q " + windows())
def i18(spark, sf):
    df = with_market(spark, sf).withColumn("crack", F.col("close") * 42 - F.col("market"))
    df = df.withColumn("__c", F.greatest("crack", F.lit(1.0)))
    return df.select("symbol", "date", (F.col("close") - F.col("market")).alias("spread"), "crack", r(ind.log_return("__c", 5), 4).alias("crack_r5"))


V2060 = "v AS (SELECT *, " + f"{vol(20)} AS v20, {vol(60)} AS v60" + " FROM r " + windows(20, 60) + ")"


@query("I19_vol_ratio", PX + ", " + R1 + ", " + V2060 + " " + KEY + rnd("v20/(v60+1e-9)", "vol_ratio") + ", " + rnd("v20-lag(v20,5) OVER w", "vol_accel") + " FROM v " + windows())
def i19(spark, sf):
    df = staged(px(spark, sf), {"r1": ind.log_return("close")}, {"v20": ind.rolling_vol("r1", 20), "v60": ind.rolling_vol("r1", 60)})
    return out(df, "symbol date", vol_ratio=F.col("v20") / (F.col("v60") + EPS), vol_accel=ind.difference("v20", 5))


@query("I20_trend_align", PX + ", m AS (SELECT *, " + ", ".join(f"{mean('close', n)} AS m{n}" for n in (20, 60, 200)) + " FROM prices " + windows(20, 60, 200)
       + "), a AS (SELECT *, CASE WHEN m20>m60 AND m60>m200 THEN 1.0 ELSE 0.0 END AS al FROM m) " + KEY + rnd(mean("al", 20), "align20") + " FROM a " + windows(20))
def i20(spark, sf):
    df = px(spark, sf).withColumns({f"m{n}": ind.rolling_mean("close", n) for n in (20, 60, 200)})
    al = F.coalesce((F.col("m20") > F.col("m60")) & (F.col("m60") > F.col("m200")), F.lit(False))
    return out(df.withColumn("al", al), "symbol date", align20=ind.share_true("al", 20))


@query("I21_term_structure", PX + ", " + MARKET + ", q AS (SELECT *, close/(market+1e-9) AS curve FROM pm), z AS (SELECT *, CASE WHEN curve>1 THEN 1.0 ELSE 0.0 END AS inv FROM q) " + KEY
       + rnd("curve", "curve", 4) + ", " + rnd("curve-lag(curve,5) OVER w", "curve_chg5", 4) + ", " + rnd(mean("inv", 5), "inverted5") + " FROM z " + windows(5))
def i21(spark, sf):
    df = with_market(spark, sf).withColumn("curve", F.col("close") / (F.col("market") + EPS)).withColumn("inv", F.col("curve") > 1)
    return df.select("symbol", "date", r("curve", 4).alias("curve"), r(ind.difference("curve", 5), 4).alias("curve_chg5"), r(ind.share_true("inv", 5)).alias("inverted5"))


@query("I22_above_low", PX + ", m AS (SELECT *, " + gated("min(close)", "close", 10) + " AS lo FROM prices " + windows(10) + ") " + KEY + rnd("(close-lo)/(lo+1e-9)", "above_low10") + " FROM m")
def i22(spark, sf):
    return out(px(spark, sf), "symbol date", above_low10=ind.above_low("close", 10))


@query("I23_lagged_returns", PX + ", " + R1 + " " + KEY + ", ".join(rnd(f"lag(r1,{k}) OVER w", f"lag{k}") for k in (1, 2, 3, 5, 10)) + " FROM r " + windows())
def i23(spark, sf):
    df = px(spark, sf).withColumn("r1", ind.log_return("close"))
    return out(df, "symbol date", **{f"lag{k}": ind.lagged("r1", k) for k in (1, 2, 3, 5, 10)})


@query("I24_z_divergence", PX + ", s AS (SELECT *, ln(close/lag(close,5) OVER w) AS a, volume-lag(volume,5) OVER w AS b FROM prices " + windows()
       + "), z AS (SELECT *, " + zscore("a") + " - " + zscore("b") + " AS d FROM s " + windows(252) + ") " + KEY + rnd(zscore("d"), "divergence", 4) + " FROM z " + windows(252))
def i24(spark, sf):
    df = px(spark, sf).withColumns({"a": ind.log_return("close", 5), "b": ind.difference("volume", 5)})
    scored = rolling_z_all(df.select("symbol", "date", "a", "b"), ["a", "b"], gaps={"divergence": ("a", "b")})
    return out(scored, "symbol date", 4, divergence="divergence")


@query("I25_vol_adjusted_momentum", PX + ", r AS (SELECT *, ln(close/lag(close) OVER w) AS r1, ln(close/lag(close,21) OVER w) AS r21, ln(close/lag(close,63) OVER w) AS r63, ln(close/lag(close,126) OVER w) AS r126 FROM prices "
       + windows() + "), v AS (SELECT *, " + vol(20) + " AS v20 FROM r " + windows(20) + ") " + KEY + cols("r63", "r126") + ", " + rnd("r21-lag(r21,5) OVER w", "r21_chg5") + ", " + rnd("r21/(v20+1e-9)", "vol_adj_r21") + " FROM v " + windows())
def i25(spark, sf):
    df = px(spark, sf).withColumns({f"r{p}": ind.log_return("close", p) for p in (1, 21, 63, 126)})
    return out(df, "symbol date", r63="r63", r126="r126", r21_chg5=ind.difference("r21", 5), vol_adj_r21=F.col("r21") / (ind.rolling_vol("r1", 20) + EPS))


@query("I26_attention_chase", PX + ", " + INTEREST_SQL + ", att AS (SELECT date, avg(value) AS att FROM interest GROUP BY 1), j AS (SELECT p.symbol, p.date, p.close, a.att FROM prices p ASOF LEFT JOIN att a ON p.date>=a.date) " + KEY
       + rnd("(att-lag(att,4) OVER w)/(abs(ln(close/lag(close,21) OVER w))+0.01)", "chase", 5) + " FROM j " + windows())
def i26(spark, sf):
    att = driver.interest(spark, sf).groupBy("date").agg(F.avg("value").alias("att"))
    df = pnl.asof_join(px(spark, sf).select("symbol", "date", "close"), att, ["att"])
    return out(df, "symbol date", 5, chase=ind.difference("att", 4) / (F.abs(ind.log_return("close", 21)) + 0.01))


@query("I27_dollar_volume", PX + ", d AS (SELECT symbol, date, close*volume AS dv FROM prices), m AS (SELECT symbol, " + gated("avg(dv)", "dv", 252) + " AS dv252 FROM d " + windows(252) + ") SELECT symbol, " + rnd("avg(dv252)", "avg_dollar_volume", 3) + " FROM m GROUP BY 1")
def i27(spark, sf):
    panel = scr.returns_panel(px(spark, sf))
    return out(panel.groupBy("symbol").agg(F.avg("dollar_volume").alias("dv")), "symbol", 3, avg_dollar_volume="dv")


@query("I28_positioning", "WITH " + POSITIONS_SQL + " SELECT market, report_date, spec_long-spec_short AS net_spec, comm_long-comm_short AS net_comm, " + rnd("(spec_long-spec_short)/(open_int+1e-9)", "spec_oi_ratio")
       + ", " + rnd("(comm_long-comm_short)/(open_int+1e-9)", "comm_oi_ratio") + ", (spec_long-spec_short)-(comm_long-comm_short) AS spec_comm_gap FROM positions")
def i28(spark, sf):
    return out(ind.positioning(driver.positions(spark, sf)), "market report_date net_spec net_comm spec_comm_gap", spec_oi_ratio="spec_oi_ratio", comm_oi_ratio="comm_oi_ratio")


@query("I29_rolling_sharpe", PX + ", " + R1 + " " + KEY + rnd(f"({mean('r1', 63)})/(({gated('stddev_pop(r1)', 'r1', 63)})+1e-9)*sqrt(252)", "sharpe63", 5) + " FROM r " + windows(63))
def i29(spark, sf):
    return out(px(spark, sf).withColumn("r1", ind.log_return("close")), "symbol date", 5, sharpe63=ind.rolling_sharpe("r1"))


@query("I30_realised_vol", PX + ", " + R1 + ", v AS (SELECT symbol, date, " + vol(20) + "*100 AS rv FROM r " + windows(20) + ") SELECT symbol, max(date) AS date, " + rnd("arg_max(rv,date)", "realised_vol") + ", arg_max(rv,date)<12 AS low_vol FROM v GROUP BY 1")
def i30(spark, sf):
    df = staged(px(spark, sf), {"r1": ind.log_return("close")}, {"rv": ind.rolling_vol("r1", 20) * 100})
    last = pnl.latest(df.select("symbol", "date", "rv"))
    return last.select("symbol", "date", r("rv").alias("realised_vol"), (F.col("rv") < 12).alias("low_vol"))


@query("I31_market_snapshot", PX + ", s AS (SELECT *, close-lag(close) OVER w AS chg, (close/lag(close) OVER w-1)*100 AS chg_pct, max(close) OVER w5 AS hi5, min(close) OVER w5 AS lo5, max(close) OVER w20 AS hi20, min(close) OVER w20 AS lo20, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn FROM prices "
       + windows(5, 20) + ") " + KEY + "close, " + cols("chg", "chg_pct", "hi5", "lo5", "hi20", "lo20") + ", " + rnd("(close-lo20)/(hi20-lo20+1e-9)*100", "in_range_pct", 5) + " FROM s WHERE rn=1")
def i31(spark, sf):
    df = px(spark, sf).withColumns({
        "chg": ind.difference("close", 1), "chg_pct": ind.simple_return("close") * 100,
        "hi5": ind.rolling_max("close", 5, 1), "lo5": ind.rolling_min("close", 5, 1),
        "hi20": ind.rolling_max("close", 20, 1), "lo20": ind.rolling_min("close", 20, 1),
    })
    last = pnl.latest(df)
    pos = (F.col("close") - F.col("lo20")) / (F.col("hi20") - F.col("lo20") + EPS) * 100
    return last.select("symbol", "date", "close", *[r(c).alias(c) for c in ("chg", "chg_pct", "hi5", "lo5", "hi20", "lo20")], r(pos, 5).alias("in_range_pct"))


@query("I32_trend_rule", PX + ", m AS (SELECT *, " + f"{mean('close', 5)} AS m5, {mean('close', 20)} AS m20" + " FROM prices " + windows(5, 20) + ") SELECT symbol, date, CASE WHEN round(close-m20,9)>0 AND round(m5-m20,9)>0 THEN 1 ELSE -1 END AS trend, coalesce(round(close-m20,9)>0,false) AS above_ma20 FROM m")
def i32(spark, sf):
    df = px(spark, sf).withColumns({"m5": ind.rolling_mean("close", 5), "m20": ind.rolling_mean("close", 20)})
    above = F.coalesce(F.round(F.col("close") - F.col("m20"), 9) > 0, F.lit(False))
    rising = F.coalesce(F.round(F.col("m5") - F.col("m20"), 9) > 0, F.lit(False))
    return df.select("symbol", "date", F.when(above & rising, 1).otherwise(-1).alias("trend"), above.alias("above_ma20"))


@query("I33_smoothing", PX + KEY + rnd("avg(close) OVER w5", "smooth5") + " FROM prices " + windows(5))
def i33(spark, sf):
    return out(px(spark, sf), "symbol date", smooth5=ind.rolling_mean("close", 5, 1))


FEATURES = ("r5", "r21", "vol20", "ma50_dist", "rsi14", "vol_regime", "trend_strength", "r63", "vol_adj_r21")
RAW_SQL = (
    PX + ", r AS (SELECT *, ln(close/lag(close) OVER w) AS r1, ln(close/lag(close,5) OVER w) AS r5, ln(close/lag(close,21) OVER w) AS r21, ln(close/lag(close,63) OVER w) AS r63, close-lag(close) OVER w AS chg FROM prices " + windows()
    + "), g AS (SELECT *, CASE WHEN chg IS NOT NULL THEN greatest(chg,0) END AS up, CASE WHEN chg IS NOT NULL THEN -least(chg,0) END AS dn FROM r), v AS (SELECT *, "
    + f"{vol(20)} AS vol20, {vol(60)} AS vol60, close/({mean('close', 50)})-1 AS ma50_dist, (1-1/(1+({mean('up', 14)})/(({mean('dn', 14)})+1e-9))) AS rsi14, "
    + f"(({mean('close', 20)})-({mean('close', 200)}))/(({mean('close', 200)})+1e-9) AS trend_strength, "
    + "(" + "+".join(f"ln(lead(close,{h}) OVER w/close)" for h in (17, 18, 19, 20)) + ")/4 AS target FROM g " + windows(14, 20, 50, 60, 200)
    + "), f AS (SELECT *, vol20/(vol60+1e-9) AS vol_regime, r21/(vol20+1e-9) AS vol_adj_r21 FROM v), z AS (SELECT symbol, date, target, "
    + ", ".join(f"{zscore(c)} AS {c}" for c in FEATURES) + " FROM f " + windows(252) + ")"
)


def feature_table(spark, sf):
    wanted = set(FEATURES)
    specs = [f for f in feat.price_block() + feat.momentum_block() if f.name in wanted or not f.keep]
    df, names = feat.build_features(px(spark, sf).drop("volume"), specs)
    return df, names


@query("F0_build_features", RAW_SQL + " SELECT symbol, date, " + cols("target") + ", " + cols(*FEATURES, digits=4) + " FROM z")
def f0(spark, sf):
    df, _ = feature_table(spark, sf)
    return df.select("symbol", "date", r("target").alias("target"), *[r(c, 4).alias(c) for c in FEATURES])


CELL_OF = dict(zip(feat.REFERENCES, ("AF", "NO", "RF")))


def reference_days(spark, sf):
    """Three reference series on the trading calendar."""
    wide = driver.prices(spark, sf, "cell").groupBy("date").agg(*[F.max(F.when(F.col("symbol") == s, F.col("close"))).alias(c) for c, s in CELL_OF.items()])
    return pnl.ffill(wide.withColumn("board", F.lit(1)), list(CELL_OF), ["board"]).drop("board")


def _reference_sql():
    refs, pairs = list(CELL_OF), list(combinations(CELL_OF, 2))
    raw = [f"ln({c}/lag({c},{n}) OVER w) AS {c}_r{n}" for c in refs for n in (1, 5, 21)] + [f"{a}/({b}+1e-9) AS {a}_{b}_level" for a, b in pairs]
    raw += ["second/(third+1e-9) AS second_curve", "anchor-second AS anchor_second_spread"]
    two = [f"{gated(f'stddev_samp({c}_r1)', f'{c}_r1', 20)}*sqrt(252) AS {c}_vol20" for c in refs]
    two += [f"CASE WHEN regr_count({a}_r1,{b}_r1) OVER w20>=20 AND NOT isnan(corr({a}_r1,{b}_r1) OVER w20) THEN corr({a}_r1,{b}_r1) OVER w20 END AS {a}_{b}_corr20" for a, b in pairs]
    two += ["second_curve-lag(second_curve,5) OVER w AS second_curve_chg5", gated("avg(CASE WHEN second_curve>1 THEN 1.0 ELSE 0.0 END)", "1", 5) + " AS second_inverted"]
    two += ["ln(greatest(anchor_second_spread,1)/lag(greatest(anchor_second_spread,1),5) OVER w) AS anchor_second_spread_r5"]
    return "WITH " + prices_sql("cell") + ", p AS (SELECT date, " + ", ".join(f"max(CASE WHEN symbol='{s}' THEN close END) AS {c}" for c, s in CELL_OF.items()) + (
        " FROM prices GROUP BY 1), m AS (SELECT 'm' AS symbol, date, " + ", ".join(f"last_value({c} IGNORE NULLS) OVER u AS {c}" for c in refs)
        + " FROM p WINDOW u AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), a AS (SELECT *, " + ", ".join(raw) + " FROM m " + windows() + "), b AS (SELECT *, " + ", ".join(two) + " FROM a " + windows(5, 20)
        + ") SELECT date, " + ", ".join(f"round({zscore(c)},4)+0.0 AS {c}" for c in REFERENCE_NAMES) + " FROM b " + windows(252))


REFERENCE_SPECS = feat.reference_block(feat.REFERENCES) + feat.term_structure_block("second", "third") + feat.spread_block("anchor", "second")
REFERENCE_NAMES = [f.name for f in REFERENCE_SPECS if f.keep]


@query("F0_reference_blocks", _reference_sql())
def f0_references(spark, sf):
    """Returns, volatilities, ratios and correlations of three references, their curve and spread, scored."""
    df, names = feat.market_features(reference_days(spark, sf), REFERENCE_SPECS)
    return df.select("date", *[r(c, 4).alias(c) for c in names])


def market_days(spark, sf):
    """The market-wide series on the trading calendar: anchor, macro, positioning, holdings, attention."""
    days = reference_days(spark, sf)
    days = feat.attach_series(days, driver.macro(spark, sf).drop("series"), "gpr", lag_bdays=1)
    # One position book over all markets.
    held = [F.sum(c).alias(c) for c in ("spec_long", "spec_short", "comm_long", "comm_short", "open_int")]
    pos = ind.positioning(driver.positions(spark, sf).groupBy(F.col("report_date").alias("date")).agg(*held))
    days = pnl.asof_join(days, pos, ["net_spec", "net_comm", "spec_oi_ratio"], lag_bdays=3)
    held = driver.table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    days = feat.attach_series(days, held, "holdings", lag_bdays=1)
    att = driver.interest(spark, sf).groupBy("date").agg(F.avg("value").alias("value"))
    return feat.attach_series(days, att, "attention")


def full_feature_table(spark, sf, kind="metals", digits=None):
    """Every block of a variant: price, relation, macro, positioning, holdings, interest and calendar features."""
    panel = driver.prices(spark, sf).drop("volume")
    return feat.build_variant(panel, market_days(spark, sf), feat.variant(kind), driver.tasks(spark, sf), digits)


def _all_features(kind):
    def run(spark, sf):
        df, names = full_feature_table(spark, sf, kind, digits=4)
        return df.select("symbol", "date", r("target").alias("target"), *names)

    return run


for _kind in ("metals", "technology", "energy"):
    query(f"F0_all_blocks_{_kind}")(_all_features(_kind))
