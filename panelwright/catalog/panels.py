"""Cleaning, calendars and joins: D1-D14, C1-C7, J1-J13."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import indicators as ind
from ..functions.dates import add_bdays, cyclic, season_flags
from ..functions.expr import clip, r
from ..operators import calendar as cal
from ..operators import panel as pnl
from ..operators import splits, validation
from ..sources import driver
from .base import (
    BDAYS_SQL, MACRO_SQL, POSITIONS_SQL, cols, out, predictions_sql, prices_sql, query, rnd, windows,
)

PX = prices_sql()
PX_CELL = prices_sql("cell")


@query("D1_normalize_dates", """SELECT user_id, date, event_id, event_type, value FROM (
    SELECT *, CAST(ts AS DATE) AS date, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS rn
    FROM events) WHERE rn=1""")
def d1(spark, sf):
    ev = driver.table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return pnl.normalize_dates(ev, "ts", ["user_id"], ["event_id"]).select("user_id", "date", "event_id", "event_type", "value")


@query("D2_dedup_max", """SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER
    (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn=1""")
def d2(spark, sf):
    orders = driver.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return pnl.keep_by_max(orders, ["o_custkey"], [F.col("o_totalprice"), F.col("o_orderkey")])


@query("D3_dedup_newest_window", "WITH " + predictions_sql() + """, f AS (SELECT symbol, date, g AS fold, pred*(1+0.05*(g-4)) AS pred
    FROM predictions, range(9) t(g)) SELECT symbol, date, CAST(fold AS INTEGER) AS fold, pred
    FROM (SELECT *, row_number() OVER (PARTITION BY symbol, date ORDER BY fold DESC) AS rn FROM f) WHERE rn=1""")
def d3(spark, sf):
    folds = driver.fold_predictions(spark, sf).select("symbol", "date", "fold", "pred")
    return pnl.keep_by_max(folds, ["symbol", "date"], "fold")


@query("D4_text_match", """SELECT CASE WHEN upper(o_orderpriority) LIKE '%URGENT%' THEN 'name' ELSE 'code' END AS hit,
    o_orderpriority, count(*) AS n FROM orders WHERE upper(o_orderpriority) LIKE '%URGENT%' OR starts_with(trim(o_orderpriority),'2')
    GROUP BY 1,2""")
def d4(spark, sf):
    by_name = pnl.text_match("o_orderpriority", contains="urgent")
    by_code = pnl.text_match("o_orderpriority", startswith="2")
    hits = driver.table(spark, sf, "orders").filter(by_name | by_code)
    return hits.groupBy(F.when(by_name, "name").otherwise("code").alias("hit"), "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("D5_clean_inf", "SELECT l_suppkey, count(l_tax/nullif(l_discount,0)) AS n, " + rnd("avg(l_tax/nullif(l_discount,0))", "mean_ratio") + """
    FROM lineitem GROUP BY 1""")
def d5(spark, sf):
    ratio = F.when(F.col("l_discount") == 0, F.lit(float("inf"))).otherwise(F.try_divide("l_tax", "l_discount"))
    li = pnl.clean_inf(driver.table(spark, sf, "lineitem").select("l_suppkey", ratio.alias("x")), ["x"])
    return li.groupBy("l_suppkey").agg(F.count("x").alias("n"), r(F.avg("x")).alias("mean_ratio"))


@query("D6_drop_all_null", "WITH " + PX + " SELECT symbol, date, " + cols("close") + " FROM prices")
def d6(spark, sf):
    px = driver.prices(spark, sf).withColumn("empty", F.when(F.col("close") < 0, F.col("close")))
    return out(pnl.drop_all_null(px, ["close", "empty"]).drop("volume"), "symbol date", close="close")


RETS = {"r1": 1, "r5": 5, "r21": 21, "r63": 63}
RETS_SQL = "rets AS (SELECT symbol, date, " + ", ".join(f"ln(close/lag(close,{n}) OVER w) AS {k}" for k, n in RETS.items()) + """,
    ln(lead(close,20) OVER w/close) AS target FROM prices """ + windows() + ")"


def returns(spark, sf):
    px = driver.prices(spark, sf)
    out_ = {k: ind.log_return("close", n) for k, n in RETS.items()}
    return px.withColumns({**out_, "target": ind.forward_log_return("close", 20)}).select("symbol", "date", *RETS, "target")


@query("D7_null_rates", "WITH " + PX + ", " + RETS_SQL + " SELECT feature, round(null_rate,6)+0.0 AS null_rate FROM (" + " UNION ALL ".join(
    f"SELECT '{k}' AS feature, avg(CASE WHEN {k} IS NULL THEN 1.0 ELSE 0.0 END) AS null_rate FROM rets" for k in RETS) + ")")
def d7(spark, sf):
    return out(pnl.null_rates(returns(spark, sf), list(RETS)), "feature", null_rate="null_rate")


@query("D8_drop_sparse", "WITH " + PX + ", " + RETS_SQL + " SELECT symbol, date, " + cols("r1", "r5", "r21") + " FROM rets")
def d8(spark, sf):
    # The 63-row return lacks its first rows in every symbol: above 10 % of rows at any size of the tables.
    kept = pnl.drop_sparse(returns(spark, sf).drop("target"), list(RETS), limit=0.10)
    return kept.select("symbol", "date", *[r(c).alias(c) for c in kept.columns if c in RETS])


@query("D9_complete_cases", "WITH " + PX + ", " + RETS_SQL + " SELECT symbol, date, " + cols(*RETS, "target") + """
    FROM rets WHERE r1 IS NOT NULL AND r5 IS NOT NULL AND r21 IS NOT NULL AND r63 IS NOT NULL AND target IS NOT NULL""")
def d9(spark, sf):
    full = pnl.complete_cases(returns(spark, sf), list(RETS), "target")
    return out(full, "symbol date", **{c: c for c in [*RETS, "target"]})


@query("D10_align_schema", "WITH " + PX + ", " + RETS_SQL + " SELECT symbol, date, " + ", ".join(
    f"round(coalesce({c},0),6)+0.0 AS {c}" for c in ("r63", "r1")) + ", 0.0::DOUBLE AS absent FROM rets")
def d10(spark, sf):
    got = pnl.align_schema(returns(spark, sf), ["r63", "absent", "r1"], ["symbol", "date"])
    return out(got, "symbol date", r63="r63", absent="absent", r1="r1")


GAPPY = "gappy AS (SELECT symbol, date, CASE WHEN volume>=30 THEN close END AS px FROM prices)"


def gappy(spark, sf):
    return driver.prices(spark, sf).select("symbol", "date", F.when(F.col("volume") >= 30, F.col("close")).alias("px"))


@query("D11_ffill", "WITH " + PX + ", " + GAPPY + " SELECT symbol, date, " + rnd("last_value(px IGNORE NULLS) OVER u", "px") + " FROM gappy " + windows())
def d11(spark, sf):
    return out(pnl.ffill(gappy(spark, sf), ["px"]), "symbol date", px="px")


@query("D12_bfill", "WITH " + PX + ", " + GAPPY + " SELECT symbol, date, " + rnd(
    "first_value(px IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)", "px") + " FROM gappy")
def d12(spark, sf):
    return out(pnl.bfill(gappy(spark, sf), ["px"]), "symbol date", px="px")


@query("D13_ffill_limited", "WITH " + PX + ", " + GAPPY + """, f AS (SELECT symbol, date, last_value(px IGNORE NULLS) OVER u AS v,
    max(CASE WHEN px IS NOT NULL THEN date END) OVER u AS d FROM gappy """ + windows() + ") SELECT symbol, date, " + rnd("CASE WHEN date-d<=5 THEN v END", "px") + " FROM f")
def d13(spark, sf):
    return out(pnl.ffill(gappy(spark, sf), ["px"], max_age_days=5), "symbol date", px="px")


@query("D14_clip", "WITH " + PX + " SELECT symbol, date, " + rnd("CASE WHEN chg IS NOT NULL THEN greatest(chg,0) END", "gain") + ", " + rnd(
    "CASE WHEN chg IS NOT NULL THEN least(greatest(chg,-1),1) END", "bounded") + " FROM (SELECT *, close-lag(close) OVER w AS chg FROM prices " + windows() + ")")
def d14(spark, sf):
    px = driver.prices(spark, sf).withColumn("chg", ind.difference("close", 1))
    return out(px, "symbol date", gain=clip("chg", lower=0.0), bounded=clip("chg", -1.0, 1.0))


@query("C1_bday_calendar", "WITH " + BDAYS_SQL + """ SELECT date, CAST(idx AS INTEGER) AS bday_idx FROM bdays
    WHERE date BETWEEN (SELECT min(CAST(o_orderdate AS DATE)) FROM orders) AND (SELECT max(CAST(o_orderdate AS DATE)) FROM orders)""")
def c1(spark, sf):
    orders = driver.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date"))
    return cal.bday_calendar_of(orders)


@query("C2_add_bdays", "WITH " + BDAYS_SQL + ", d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders), " + """
    p AS (SELECT d.date, max(b.idx) AS idx FROM d JOIN bdays b ON b.date<=d.date AND b.date>d.date-3 GROUP BY 1)
    SELECT p.date, b1.date AS plus1, b3.date AS plus3, b12.date AS minus12 FROM p JOIN bdays b1 ON b1.idx=p.idx+1
    JOIN bdays b3 ON b3.idx=p.idx+3 JOIN bdays b12 ON b12.idx=p.idx-12""")
def c2(spark, sf):
    days = driver.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    return days.select("date", add_bdays("date", 1).alias("plus1"), add_bdays("date", 3).alias("plus3"), add_bdays("date", -12).alias("minus12"))


@query("C3_densify", "WITH " + POSITIONS_SQL + ", " + BDAYS_SQL + """, span AS (SELECT market, min(report_date) AS lo, max(report_date) AS hi FROM positions GROUP BY 1),
    grid AS (SELECT market, b.date FROM span JOIN bdays b ON b.date BETWEEN lo AND hi)
    SELECT g.market, g.date, p.report_date AS observed, p.open_int FROM grid g ASOF JOIN positions p ON g.market=p.market AND g.date>=p.report_date""")
def c3(spark, sf):
    pos = driver.positions(spark, sf).select("market", F.col("report_date").alias("date"), "open_int")
    return cal.densify(pos, ["market"]).select("market", "date", "observed", "open_int")


@query("C4_panel_align", "WITH " + PX + """, d AS (SELECT DISTINCT date FROM prices), s AS (SELECT symbol, min(date) AS lo FROM prices GROUP BY 1),
    grid AS (SELECT symbol, date FROM d JOIN s ON date>=lo),
    al AS (SELECT g.symbol, g.date, p.close, p.date<>g.date AS filled FROM grid g ASOF JOIN prices p ON g.symbol=p.symbol AND g.date>=p.date)
    SELECT symbol, CAST(year(date) AS INTEGER) AS year, count(*) AS n, count(*) FILTER (WHERE filled) AS n_filled, """ + rnd("sum(close)", "sum_close", 4) + """,
    """ + rnd("arg_max(close,date)", "last_close") + " FROM al GROUP BY 1,2")
def c4(spark, sf):
    al = cal.panel_align(driver.prices(spark, sf).drop("volume"))
    return al.groupBy("symbol", F.year("date").alias("year")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("filled").alias("n_filled"), r(F.sum("close"), 4).alias("sum_close"),
        r(F.max_by("close", "date")).alias("last_close"),
    )


CYC = ("month_sin", "month_cos", "week_sin", "week_cos")


@query("C5_cyclic", """SELECT symbol, date, round(sin(2*pi()*month(date)/12),6)+0.0 AS month_sin, round(cos(2*pi()*month(date)/12),6)+0.0 AS month_cos,
    round(sin(2*pi()*weekofyear(date)/52),6)+0.0 AS week_sin, round(cos(2*pi()*weekofyear(date)/52),6)+0.0 AS week_cos
    FROM (SELECT DISTINCT 'S'||CAST(l_suppkey AS VARCHAR) AS symbol, CAST(l_shipdate AS DATE) AS date FROM lineitem)""")
def c5(spark, sf):
    days = driver.table(spark, sf, "lineitem").select(driver.symbol_of("supplier").alias("symbol"), F.to_date("l_shipdate").alias("date")).distinct()
    return out(days, "symbol date", **cyclic("date"))


@query("C6_season_flags", """SELECT symbol, date, ins AS in_season, pre AS pre_season, CASE WHEN count(ins) OVER w5>=5 THEN sum(ins) OVER w5 END AS phase FROM (
    SELECT symbol, date, CASE WHEN month(date) IN (1,4,7,10) AND day(date)>=10 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS ins,
    CASE WHEN month(date) IN (12,3,6,9) AND day(date)>=20 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS pre
    FROM (SELECT DISTINCT 'S'||CAST(l_suppkey AS VARCHAR) AS symbol, CAST(l_shipdate AS DATE) AS date FROM lineitem)) """ + windows(5))
def c6(spark, sf):
    days = driver.table(spark, sf, "lineitem").select(driver.symbol_of("supplier").alias("symbol"), F.to_date("l_shipdate").alias("date")).distinct()
    flagged = days.withColumns(season_flags("date"))
    return flagged.withColumn("phase", ind.rolling_sum("in_season", 5))


@query("C7_last_window", "WITH " + PX + """ SELECT symbol, date, close FROM (SELECT *, max(date) OVER (PARTITION BY symbol) AS m FROM prices) WHERE date>=m-730""")
def c7(spark, sf):
    return cal.last_window(driver.prices(spark, sf), 730, ["symbol"]).select("symbol", "date", "close")


CELLS = ("AF", "AO", "NF", "NO", "RF", "RO")


@query("J1_outer_align", "WITH " + PX_CELL + ", p AS (SELECT date, " + ", ".join(f"max(CASE WHEN symbol='{c}' THEN close END) AS {c.lower()}_" for c in CELLS) + """ FROM prices GROUP BY 1)
    SELECT date, """ + ", ".join(f"last_value({c.lower()}_ IGNORE NULLS) OVER u AS {c.lower()}_" for c in CELLS) + """
    FROM p WINDOW u AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def j1(spark, sf):
    wide = driver.prices(spark, sf, "cell").groupBy("date").pivot("symbol", list(CELLS)).agg(F.first("close")).withColumn("board", F.lit(1))
    named = wide.withColumnsRenamed({c: f"{c.lower()}_" for c in CELLS})
    return pnl.ffill(named, [f"{c.lower()}_" for c in CELLS], ["board"]).drop("board")


@query("J2_align_pair", "WITH " + PX + """, o AS (SELECT 'S'||CAST(l_suppkey AS VARCHAR) AS symbol, CAST(l_shipdate AS DATE) AS date, max(CASE WHEN l_tax>0 THEN l_tax END) AS tax FROM lineitem GROUP BY 1,2)
    SELECT p.symbol, p.date, p.close, o.tax FROM prices p JOIN o ON p.symbol=o.symbol AND p.date=o.date WHERE close IS NOT NULL AND tax IS NOT NULL""")
def j2(spark, sf):
    a = driver.prices(spark, sf).select("symbol", "date", "close")
    tax = driver.table(spark, sf, "lineitem").groupBy(driver.symbol_of("supplier").alias("symbol"), F.to_date("l_shipdate").alias("date")).agg(
        F.max(F.when(F.col("l_tax") > 0, F.col("l_tax"))).alias("tax")
    )
    return pnl.align_pair(a, tax, ["symbol", "date"])


MARKETS = ("F", "O", "P")


@query("J3_asof_join", "WITH " + PX + ", " + POSITIONS_SQL + ", " + MACRO_SQL + ", " + BDAYS_SQL + """,
    pub AS (SELECT p.market, b2.date AS date, max(p.report_date) AS report_date, arg_max(p.spec_long-p.spec_short, p.report_date) AS net_spec
        FROM positions p JOIN bdays b1 ON b1.date=p.report_date JOIN bdays b2 ON b2.idx=b1.idx+3 GROUP BY 1,2),
    mi AS (SELECT m.date, m.value, max(b.idx) AS idx FROM macro m JOIN bdays b ON b.date<=m.date AND b.date>m.date-3 GROUP BY 1,2),
    mp AS (SELECT b.date, arg_max(mi.value, mi.date) AS value, max(mi.date) AS seen FROM mi JOIN bdays b ON b.idx=mi.idx+1 GROUP BY 1),
    """ + ", ".join(f"pub{m} AS (SELECT * FROM pub WHERE market='{m}')" for m in MARKETS) + """
    SELECT x.symbol, x.date, x.net_spec_f, x.net_spec_o, x.net_spec_p, CASE WHEN x.date-mp.seen<=5 THEN mp.value END AS order_value FROM
    (SELECT p.symbol, p.date, """ + ", ".join(f"pub{m}.net_spec AS net_spec_{m.lower()}" for m in MARKETS) + " FROM prices p " + " ".join(f"ASOF LEFT JOIN pub{m} ON p.date>=pub{m}.date" for m in MARKETS) + """) x
    ASOF LEFT JOIN mp ON x.date>=mp.date""")
def j3(spark, sf):
    both = driver.prices(spark, sf).select("symbol", "date")
    pos = driver.positions(spark, sf)
    for m in MARKETS:
        own = pos.filter(F.col("market") == m).select(F.col("report_date").alias("date"), (F.col("spec_long") - F.col("spec_short")).alias(f"net_spec_{m.lower()}"))
        both = pnl.asof_join(both, own, [f"net_spec_{m.lower()}"], lag_bdays=3)
    value = driver.macro(spark, sf).select("date", F.col("value").alias("order_value"))
    return pnl.asof_join(both, value, ["order_value"], lag_bdays=1, max_age_days=5)


@query("J4_nearest_join", "WITH " + PX + """, o AS (SELECT CAST(o_orderdate AS DATE) AS date, sum(o_totalprice) AS v FROM orders GROUP BY 1),
    d AS (SELECT DISTINCT symbol, date FROM prices),
    c AS (SELECT d.symbol, d.date, o.date AS od, o.v, row_number() OVER (PARTITION BY d.symbol, d.date ORDER BY abs(d.date-o.date), o.date) AS rn
        FROM d LEFT JOIN o ON o.date BETWEEN d.date-3 AND d.date+3)
    SELECT symbol, date, od AS matched_date, """ + rnd("v", "order_sum", 2) + " FROM c WHERE rn=1")
def j4(spark, sf):
    px = driver.prices(spark, sf).select("symbol", "date")
    daily = driver.table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.sum("o_totalprice").alias("order_sum"))
    return out(pnl.nearest_join(px, daily, ["order_sum"]), "symbol date matched_date", 2, order_sum="order_sum")


OOF_SQL = "oof AS (SELECT symbol, date, pred FROM predictions WHERE is_oof)"


@query("J5_mark_oof", "WITH " + predictions_sql() + ", " + OOF_SQL + """ SELECT p.symbol, p.date, o.symbol IS NOT NULL AS is_oof
    FROM prices p LEFT JOIN (SELECT DISTINCT symbol, date FROM oof) o ON o.symbol=p.symbol AND o.date=p.date""")
def j5(spark, sf):
    full = driver.prices(spark, sf).select("symbol", "date")
    return pnl.mark_members(full, driver.predictions(spark, sf).filter("is_oof"), ["symbol", "date"])


@query("J6_non_oof", "WITH " + predictions_sql() + ", " + OOF_SQL + """ SELECT p.symbol, p.date, p.pred FROM predictions p
    LEFT JOIN (SELECT DISTINCT symbol, date FROM oof) o ON o.symbol=p.symbol AND o.date=p.date WHERE o.symbol IS NULL""")
def j6(spark, sf):
    preds = driver.predictions(spark, sf).select("symbol", "date", "pred", "is_oof")
    return pnl.non_members(preds, preds.filter("is_oof"), ["symbol", "date"]).drop("is_oof")


@query("J7_overlay", "WITH " + predictions_sql() + """ SELECT symbol, date, CASE WHEN is_oof THEN pred ELSE pred/2 END AS pred FROM predictions""")
def j7(spark, sf):
    preds = driver.predictions(spark, sf).select("symbol", "date", "pred", "is_oof")
    fill = preds.select("symbol", "date", (F.col("pred") / 2).alias("pred"))
    return pnl.overlay(fill, preds.filter("is_oof"), ["symbol", "date"])


@query("J8_lookup0", "WITH " + predictions_sql() + " SELECT p.symbol, p.date, coalesce(q.pred,0)+0.0 AS pred FROM prices p LEFT JOIN predictions q ON p.symbol=q.symbol AND p.date=q.date")
def j8(spark, sf):
    px = driver.prices(spark, sf).select("symbol", "date")
    return pnl.lookup0(px, driver.predictions(spark, sf), ["symbol", "date"], "pred")


@query("J9_union_dates", """WITH a AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders), b AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem)
    SELECT date FROM (SELECT date FROM a UNION SELECT date FROM b) WHERE date>=greatest((SELECT min(date) FROM a),(SELECT min(date) FROM b))""")
def j9(spark, sf):
    a = driver.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date"))
    b = driver.table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("date"))
    return pnl.union_dates(a, b)


@query("J10_common_window", "WITH " + PX + """ SELECT max(lo) AS window_start, min(hi) AS window_end FROM (SELECT symbol, min(date) AS lo, max(date) AS hi FROM prices GROUP BY 1)""")
def j10(spark, sf):
    return pnl.common_window(driver.prices(spark, sf), ["symbol"])


@query("J11_anchor_join", "WITH " + PX_CELL + """, sup AS (SELECT 'S'||CAST(l_suppkey AS VARCHAR) AS symbol, CAST(l_shipdate AS DATE) AS date, sum(l_quantity) AS q FROM lineitem GROUP BY 1,2)
    SELECT s.symbol, s.date, s.q, a.close AS anchor_close FROM sup s LEFT JOIN (SELECT date, close FROM prices WHERE symbol='AF') a ON a.date=s.date""")
def j11(spark, sf):
    anchor = driver.prices(spark, sf, "cell").filter("symbol = 'AF'").select("date", F.col("close").alias("anchor_close"))
    sup = driver.table(spark, sf, "lineitem").groupBy(driver.symbol_of("supplier").alias("symbol"), F.to_date("l_shipdate").alias("date")).agg(F.sum("l_quantity").alias("q"))
    return sup.join(anchor, "date", "left").select("symbol", "date", "q", "anchor_close")


CHUNKS_SQL = """blk AS (SELECT symbol, min(date) AS start, max(date) AS "end" FROM (SELECT symbol, date, sum(CASE WHEN date-prev>30 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS b
    FROM (SELECT symbol, date, lag(date) OVER (PARTITION BY symbol ORDER BY date) AS prev FROM predictions WHERE is_oof)) GROUP BY symbol, b),
    chunks AS (SELECT symbol, min(date) AS start, max(date) AS "end" FROM predictions GROUP BY symbol, date_trunc('month', date))"""


@query("J12_without_overlap", "WITH " + predictions_sql() + ", " + CHUNKS_SQL + """ SELECT symbol, start, "end" FROM chunks c
    WHERE NOT EXISTS (SELECT 1 FROM blk b WHERE b.symbol=c.symbol AND b.start<=c."end" AND b."end">=c.start)""")
def j12(spark, sf):
    preds = driver.predictions(spark, sf)
    blk = validation.block_table(preds.filter("is_oof"), 30, ["symbol"])
    chunks = preds.groupBy("symbol", F.date_trunc("month", "date").alias("m")).agg(F.min("date").alias("start"), F.max("date").alias("end"))
    return pnl.without_overlap(chunks.drop("m"), blk).select("symbol", "start", "end")


FOLDS = splits.WalkForward(n_folds=4, val_months=1, purge=20, min_train_years=0.5)
FOLDS_SQL = """cnt AS (SELECT symbol, count(*) AS n FROM prices GROUP BY 1),
    fb AS (SELECT symbol, n, g AS fold, CAST(trunc(CASE WHEN g=3 THEN n-21.0 ELSE 146.0+g*((n-21.0-146.0)/3.0) END) AS BIGINT) AS vs FROM cnt, range(4) t(g)),
    folds AS (SELECT symbol, n, fold, vs-20 AS train_end, vs AS val_start, least(vs+21, n) AS val_end FROM fb WHERE vs-20>=126 AND vs<n)"""


@query("J13_assign_folds", "WITH " + PX + ", " + FOLDS_SQL + """, ri AS (SELECT symbol, date, row_number() OVER (PARTITION BY symbol ORDER BY date)-1 AS i FROM prices)
    SELECT r.symbol, CAST(f.fold AS INTEGER) AS fold, CASE WHEN i<train_end THEN 'train' ELSE 'val' END AS role, count(*) AS n, min(date) AS first_date, max(date) AS last_date
    FROM ri r JOIN folds f ON r.symbol=f.symbol AND (i<train_end OR (i>=val_start AND i<val_end)) GROUP BY 1,2,3""")
def j13(spark, sf):
    rows = splits.assign_folds(driver.prices(spark, sf), FOLDS)
    return rows.groupBy("symbol", "fold", "role").agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date")
    )
