"""Rotation R1-R7, screens X1-X6, headlines T1-T3, signal log K1-K3."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import dealt, r
from ..operators import headlines as news
from ..operators import leaderboard as board
from ..operators import panel as pnl
from ..operators import rotation as rot
from ..operators import screen as scr
from ..operators import signal_log as log
from ..operators import signals as sig
from ..session import materialize, shared_folder
from ..sources import driver, texts
from ..streaming import outcomes
from .base import BDAYS_SQL, HEADLINES_SQL, ORACLES, cols, out, predictions_sql, prices_sql, query, rnd, signals_sql, windows
from .sources import CAND_SQL, candidate_blocks

# Every supplier leads a book of its own, with the next two suppliers by number as sleeves; a book trades on
# the days of any of them.
ORDER_SQL = """ex AS (SELECT g.*, CAST(substr(symbol,2) AS BIGINT)-k AS num, k FROM signals g, range(3) t(k)),
    sl AS (SELECT 'B'||CAST(num AS VARCHAR) AS book, date, symbol AS sleeve, CAST(k+1 AS INTEGER) AS rank, k=0 AS is_primary, pred, conf_pct, position AS target, actual AS ret
    FROM ex WHERE num>=0)"""


def cascade_sql(order: str) -> str:
    return f"""ga AS (SELECT *, NOT is_primary AND pred>0.002 AND conf_pct>=0.40 AS passes FROM sl),
    wa AS (SELECT *, CASE WHEN passes THEN target ELSE 0 END AS want, coalesce(max(CASE WHEN is_primary THEN target END) OVER (PARTITION BY book, date),0) AS prim FROM ga),
    le AS (SELECT *, 1-prim-coalesce(sum(want) OVER (PARTITION BY book, date ORDER BY passes DESC, {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS lft FROM wa),
    weights AS (SELECT *, CAST(CASE WHEN is_primary THEN target WHEN passes AND lft>0.01 THEN least(want,lft) ELSE 0 END AS DOUBLE) AS weight FROM le)"""


HEAD = "WITH " + predictions_sql() + ", " + signals_sql() + ", " + ORDER_SQL + ", "
FIXED = HEAD + cascade_sql("rank")
RANKED = HEAD + cascade_sql("conf_pct DESC, rank")


def sleeves(spark, sf):
    """Signals in their three roles.  The roles are a literal array exploded on the row, not a join."""
    signals = sig.build_signals(driver.predictions(spark, sf))
    roles = signals.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    roles = roles.withColumn("num", F.substring("symbol", 2, 18).cast("bigint") - F.col("k")).filter("num >= 0")
    books = roles.select(
        F.concat(F.lit("B"), F.col("num").cast("string")).alias("book"), "date", F.col("symbol").alias("sleeve"), (F.col("k") + 1).alias("rank"),
        (F.col("k") == 0).alias("is_primary"), "pred", "conf_pct", F.col("position").alias("target"), F.col("actual").alias("ret"),
    )
    n = driver.tasks(spark, sf)
    return dealt(books, n and 3 * n, "book")  # every row in three roles


def weights(spark, sf):
    return rot.cascade(sleeves(spark, sf))


@query("R1_fixed_cascade", FIXED + " SELECT book, date, sleeve, weight FROM weights")
def r1(spark, sf):
    return rot.cascade(sleeves(spark, sf), "fixed").select("book", "date", "sleeve", "weight")


@query("R2_ranked_cascade", RANKED + " SELECT book, date, sleeve, weight FROM weights")
def r2(spark, sf):
    return weights(spark, sf).select("book", "date", "sleeve", "weight")


def rot_sql(lag: int, cost: float, cash: float, log_returns: bool) -> str:
    held = f"coalesce(lag(weight,{lag}) OVER s,0)" if lag else "weight"
    grow = (lambda g: f"exp({g})") if log_returns else (lambda g: f"(1+{g})")
    return f"""gr AS (SELECT d.book, d.date, s.sleeve, s.is_primary FROM (SELECT DISTINCT book, date FROM weights) d
        JOIN (SELECT book, sleeve, bool_or(is_primary) AS is_primary FROM weights GROUP BY 1,2) s ON s.book=d.book),
    fg AS (SELECT gr.*, coalesce(w.weight,0) AS weight, coalesce(w.ret,0) AS ret FROM gr LEFT JOIN weights w ON w.book=gr.book AND w.date=gr.date AND w.sleeve=gr.sleeve),
    hd AS (SELECT *, {held} AS held FROM fg WINDOW s AS (PARTITION BY book, sleeve ORDER BY date)),
    tu AS (SELECT *, abs(held-coalesce(lag(held) OVER (PARTITION BY book, sleeve ORDER BY date),0)) AS turn, CASE WHEN held>0 THEN held*ret/20 ELSE 0 END AS g FROM hd),
    dy AS (SELECT book, date, sum(held) AS invested, sum(g) AS gain, sum(CASE WHEN is_primary THEN g ELSE 0 END) AS pg, sum(turn) AS turnover, sum(CASE WHEN is_primary THEN held ELSE 0 END) AS primary_pos FROM tu GROUP BY 1,2),
    rled AS (SELECT *, sum(ln({grow('gain')}+(1-invested)*{cash}/252-turnover*{cost})) OVER bw AS lr, sum(ln({grow('pg')})) OVER bw AS lp FROM dy
        WINDOW bw AS (PARTITION BY book ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def books(spark, sf):
    """The ledger with costs: log returns spread over the holding period, one day's lag, cash yield and cost."""
    return rot.rotation_ledger(weights(spark, sf), lag=1, cost=rot.ROTATION_COST, cash_rate=rot.ROTATION_CASH_RATE, returns="log", hold=20)


ROT = RANKED + ", " + rot_sql(1, 0.0015, 0.052, True)


@query("R3_rotation_ledger", ROT + " SELECT book, date, " + cols("invested", "turnover", "primary_pos") + ", " + rnd("exp(lr)", "rotation") + ", " + rnd("exp(lp)", "primary_only") + " FROM rled")
def r3(spark, sf):
    return out(books(spark, sf), "book date", invested="invested", turnover="turnover", primary_pos="primary_pos", rotation=F.col("rotation") / rot.CAPITAL, primary_only=F.col("primary_only") / rot.CAPITAL)


@query("R3_rotation_replay", RANKED + ", " + rot_sql(0, 0.0, 0.0, False) + " SELECT book, date, " + rnd("exp(lr)", "rotation") + ", " + rnd("exp(lp)", "primary_only") + " FROM rled")
def r3_replay(spark, sf):
    """Same-day replay without costs, returns compounded as simple returns."""
    led = rot.rotation_ledger(weights(spark, sf), lag=0, hold=20)
    return out(led, "book date", rotation=F.col("rotation") / rot.CAPITAL, primary_only=F.col("primary_only") / rot.CAPITAL)


@query("R3_wide_weights", FIXED + """ SELECT book, date, coalesce(sum(weight) FILTER (WHERE rank=1),0) AS first_pos, coalesce(sum(weight) FILTER (WHERE rank=2),0) AS second_pos, coalesce(sum(weight) FILTER (WHERE rank=3),0) AS third_pos,
    1-coalesce(sum(weight) FILTER (WHERE rank<=3),0) AS cash_pos FROM weights GROUP BY 1,2""")
def r3_wide(spark, sf):
    w = rot.cascade(sleeves(spark, sf), "fixed")
    names = F.element_at(F.create_map(F.lit(1), F.lit("first"), F.lit(2), F.lit("second"), F.lit(3), F.lit("third")), F.col("rank"))
    return rot.wide_weights(w.withColumn("sleeve", F.coalesce(names, F.lit("other"))), ["first", "second", "third"])


def primary_prices(spark, sf):
    return driver.prices(spark, sf).select(F.concat(F.lit("B"), F.substring("symbol", 2, 18)).alias("book"), "date", "close")


PRIMARY_SQL = "pp AS (SELECT 'B'||substr(symbol,2) AS book, date, close FROM prices)"


@query("R4_yearly", ROT + ", " + PRIMARY_SQL + """, ye AS (SELECT book, CAST(year(date) AS INTEGER) AS year, exp(arg_max(lr,date)) AS er, exp(arg_max(lp,date)) AS ep, avg(CASE WHEN primary_pos>0 THEN 1.0 ELSE 0.0 END)*100 AS primary_long_pct, avg(CASE WHEN invested>0 THEN 1.0 ELSE 0.0 END)*100 AS invested_pct FROM rled GROUP BY 1,2),
    bh AS (SELECT book, CAST(year(date) AS INTEGER) AS year, (arg_max(close,date)/arg_min(close,date)-1)*100 AS bh_ret_pct FROM pp GROUP BY 1,2)
    SELECT ye.book, ye.year, """ + cols("primary_long_pct", "invested_pct", "bh_ret_pct", digits=5) + ", " + rnd("(er/coalesce(lag(er) OVER w,1)-1)*100", "rotation_ret_pct", 5) + ", " + rnd("(ep/coalesce(lag(ep) OVER w,1)-1)*100", "primary_ret_pct", 5) + " FROM ye LEFT JOIN bh ON ye.book=bh.book AND ye.year=bh.year WINDOW w AS (PARTITION BY ye.book ORDER BY ye.year)")
def r4(spark, sf):
    y = rot.yearly(books(spark, sf), primary_prices(spark, sf))
    names = ("primary_long_pct", "invested_pct", "bh_ret_pct", "rotation_ret_pct", "primary_ret_pct")
    return out(y, "book year", 5, **{c: c for c in names})


@query("R4_sleeve_years", RANKED + " SELECT book, sleeve, CAST(year(date) AS INTEGER) AS year, " + rnd("avg(CASE WHEN weight>0 THEN 1.0 ELSE 0.0 END)*100", "long_pct", 5) + " FROM weights GROUP BY 1,2,3")
def r4_sleeves(spark, sf):
    return out(rot.sleeve_years(weights(spark, sf)), "book sleeve year", 5, long_pct="long_pct")


@query("R5_contribution", RANKED + ", c AS (SELECT book, sleeve, sum(weight*ret/20)*100 AS c FROM weights GROUP BY 1,2) SELECT book, sleeve, " + rnd("c", "contribution_pct", 5) + ", " + rnd("c/nullif(sum(c) OVER (PARTITION BY book),0)*100", "share_pct", 3) + " FROM c")
def r5(spark, sf):
    c = rot.contribution(weights(spark, sf))
    return c.select("book", "sleeve", r("contribution_pct", 5).alias("contribution_pct"), r("share_pct", 3).alias("share_pct"))


@query("R6_premium", ROT + ", " + PRIMARY_SQL + """, g AS (SELECT book, (exp(arg_max(lr,date)/greatest(date_diff('day',min(date),max(date))/365.25,0.01))-1)*100 AS rc, (exp(arg_max(lp,date)/greatest(date_diff('day',min(date),max(date))/365.25,0.01))-1)*100 AS pc FROM rled GROUP BY 1),
    b AS (SELECT book, (exp(ln(arg_max(close,date)/arg_min(close,date))/greatest(date_diff('day',min(date),max(date))/365.25,0.01))-1)*100 AS bc FROM pp GROUP BY 1) SELECT g.book, """ + rnd("rc", "rotation_cagr_pct", 5) + ", " + rnd("rc-pc", "premium_primary_pct", 5) + ", " + rnd("rc-bc", "premium_bh_pct", 5) + " FROM g LEFT JOIN b ON g.book=b.book")
def r6(spark, sf):
    p = rot.premium(books(spark, sf), primary_prices(spark, sf))
    return out(p, "book", 5, rotation_cagr_pct="rotation_cagr_pct", premium_primary_pct="premium_primary_pct", premium_bh_pct="premium_bh_pct")


@query("R7_sleeve_days", RANKED + """, d AS (SELECT book, sleeve, weight>0 AS h FROM weights UNION ALL SELECT book, 'cash', 1-sum(weight)>=0.99 FROM weights GROUP BY book, date)
    SELECT book, sleeve, count(*) FILTER (WHERE h) AS days, """ + rnd("avg(CASE WHEN h THEN 1.0 ELSE 0.0 END)*100", "days_pct", 5) + " FROM d GROUP BY 1,2")
def r7(spark, sf):
    return out(rot.sleeve_days(weights(spark, sf)), "book sleeve days", 5, days_pct="days_pct")


# The screens compare every supplier with one anchor: the day's total over all of them as a 'market' symbol
# would follow the candidates, so the anchor is the cell panel's AF series.
SCREEN = "WITH " + prices_sql() + ", " + prices_sql("cell").replace("cell AS", "cell2 AS").replace("FROM cell)", "FROM cell2)").replace("shock AS", "shock2 AS").replace("FROM shock)", "FROM shock2)").replace("prices AS", "cp AS") + """,
    fl AS (SELECT symbol, date, close, volume FROM prices UNION ALL SELECT symbol, date, close, volume FROM cp WHERE symbol='AF'),
    rt AS (SELECT *, ln(lead(close,20) OVER w/close) AS fwd, ln(close/lag(close) OVER w) AS daily, CASE WHEN count(close*volume) OVER w252>=252 THEN avg(close*volume) OVER w252 END AS dv FROM fl """ + windows(252) + """),
    jn AS (SELECT r.symbol, r.date, r.fwd, r.daily, r.dv, a.fwd AS af, a.daily AS ad FROM rt r LEFT JOIN rt a ON a.symbol='AF' AND a.date=r.date WHERE r.symbol<>'AF')"""


def screen_panel(spark, sf):
    anchor = driver.prices(spark, sf, "cell").filter("symbol = 'AF'")
    return driver.prices(spark, sf).unionByName(anchor)


def joint(spark, sf):
    return scr.against_anchor(scr.returns_panel(screen_panel(spark, sf)), "AF")


@query("X1_regimes", SCREEN + """, x AS (SELECT symbol, date, af, unnest(list_filter([CASE WHEN af<-0.03 THEN 'losing' END, CASE WHEN af>=-0.03 AND af<=0.03 THEN 'flat' END, CASE WHEN af<0.02 THEN 'weak' END], lambda v: v IS NOT NULL)) AS regime FROM jn) SELECT symbol, date, regime FROM x""")
def x1(spark, sf):
    return scr.regimes(joint(spark, sf)).select("symbol", "date", "regime")


REG = SCREEN + ", ov AS (SELECT symbol, avg(fwd) AS om FROM jn WHERE fwd IS NOT NULL AND af IS NOT NULL GROUP BY 1), rg AS (" + " UNION ALL ".join(
    f"SELECT symbol, '{n}' AS regime, count(CASE WHEN {c} THEN fwd END) AS n, avg(CASE WHEN {c} THEN fwd END) AS m, stddev_samp(CASE WHEN {c} THEN fwd END) AS sd, avg(CASE WHEN {c} THEN (CASE WHEN fwd>0 THEN 1.0 ELSE 0.0 END) END) AS hit FROM jn WHERE fwd IS NOT NULL AND af IS NOT NULL GROUP BY 1"
    for n, c in (("losing", "af<-0.03"), ("flat", "af>=-0.03 AND af<=0.03"), ("weak", "af<0.02"))) + """),
    st AS (SELECT rg.symbol, regime, n, CASE WHEN n>=20 THEN m*100 END AS mean_pct, CASE WHEN n>=20 THEN hit*100 END AS hit_rate_pct, CASE WHEN n>=20 THEN CASE WHEN sd>0 THEN m/sd ELSE 0 END END AS sharpe, CASE WHEN n>=20 THEN (m-om)*100 END AS alpha_pct,
    CASE WHEN n>=20 THEN CASE WHEN sd>0 THEN sd*100 ELSE 0 END END AS std_pct, CASE WHEN n>=20 THEN CASE WHEN sd>0 THEN (CASE WHEN m-om>=0 THEN 1 ELSE -1 END)*abs((m-om)*100)*sqrt(sd*100) ELSE 0 END END AS score FROM rg JOIN ov USING (symbol))"""
REG_COLUMNS = ("mean_pct", "hit_rate_pct", "sharpe", "alpha_pct", "std_pct", "score")


@query("X2_regime_stats", REG + " SELECT symbol, regime, n, " + cols(*REG_COLUMNS, digits=5) + " FROM st")
def x2(spark, sf):
    return out(scr.regime_stats(joint(spark, sf)), "symbol regime n", 5, **{c: c for c in REG_COLUMNS})


# Liquidity floor in proportion to the tables, so that it splits the candidates at every size.
FLOOR = 3100.0
SCR = REG + """, sc AS (SELECT symbol, count(CASE WHEN fwd IS NOT NULL AND af IS NOT NULL THEN 1 END) AS n_obs, coalesce(avg(dv),0)/1e6 AS avg_daily_dollar_vol_m, coalesce(avg(dv),0)>=""" + str(FLOOR) + """ AS passes_liquidity, avg(CASE WHEN af IS NOT NULL THEN fwd END)*100 AS overall_mean_pct,
    stddev_samp(CASE WHEN af IS NOT NULL THEN fwd END)*100 AS overall_std_pct, CASE WHEN count(CASE WHEN daily IS NOT NULL AND ad IS NOT NULL THEN 1 END)>30 THEN corr(daily,ad) END AS corr_with_anchor FROM jn GROUP BY 1),
    wd AS (SELECT sc.*, """ + ", ".join(f"max(CASE WHEN regime='{g}' THEN {f} END) AS {g}_{f}" for g in scr.REGIMES for f in scr.REGIME_FIELDS) + " FROM sc LEFT JOIN st USING (symbol) WHERE n_obs>=100 GROUP BY ALL)"
SCR_COLUMNS = ("overall_mean_pct", "overall_std_pct", "corr_with_anchor", *[f"{g}_{f}" for g in scr.REGIMES for f in scr.REGIME_FIELDS if f != "n"])


def screened(spark, sf):
    return scr.screen(screen_panel(spark, sf), "AF", min_dollar_volume=FLOOR)


@query("X3_screen", SCR + " SELECT symbol, n_obs, passes_liquidity, losing_n, flat_n, weak_n, " + cols(*SCR_COLUMNS, digits=5) + " FROM wd")
def x3(spark, sf):
    return out(screened(spark, sf), "symbol n_obs passes_liquidity losing_n flat_n weak_n", 5, **{c: c for c in SCR_COLUMNS})


@query("X4_top_k", SCR + ", tk AS (" + " UNION ALL ".join(f"SELECT symbol, '{g}' AS regime, {g}_score AS value FROM wd WHERE passes_liquidity AND {g}_score IS NOT NULL" for g in scr.REGIMES)
       + "), rk AS (SELECT *, row_number() OVER (PARTITION BY regime ORDER BY value DESC, symbol) AS rank FROM tk) SELECT symbol, regime, CAST(rank AS INTEGER) AS rank, " + cols("value", digits=5) + " FROM rk WHERE rank<=10")
def x4(spark, sf):
    return out(scr.top_k(screened(spark, sf)), "symbol regime rank", 5, value="value")


@query("X4_lowest_correlation", SCR + " SELECT symbol, " + cols("corr_with_anchor") + " FROM wd WHERE passes_liquidity ORDER BY wd.corr_with_anchor, symbol LIMIT 10")
def x4_corr(spark, sf):
    return out(scr.lowest_correlation(screened(spark, sf)), "symbol", corr_with_anchor="corr_with_anchor")


# Every supplier is paired with the supplier before it by number.
BASIS = "WITH " + prices_sql() + """, pr AS (SELECT 'S'||CAST(s_suppkey AS VARCHAR) AS original, 'S'||CAST(s_suppkey-1 AS VARCHAR) AS substitute FROM supplier),
    jo AS (SELECT pr.original, pr.substitute, a.date, a.close AS o, b.close AS s FROM pr JOIN prices a ON a.symbol=pr.original JOIN prices b ON b.symbol=pr.substitute AND b.date=a.date),
    wx AS (SELECT 'full' AS wname, DATE '1900-01-01' AS lo, NULL::VARCHAR AS original, NULL::VARCHAR AS substitute LIMIT 0),
    en AS (SELECT *, max(date) OVER (PARTITION BY original, substitute) AS e FROM jo),
    sl AS (SELECT *, 'full' AS window_ FROM en UNION ALL SELECT *, '5y' FROM en WHERE date>=e-1825 UNION ALL SELECT *, '2y' FROM en WHERE date>=e-730),
    re AS (SELECT *, ln(o/lag(o) OVER p) AS ro, ln(s/lag(s) OVER p) AS rs, ln(lead(o,20) OVER p/o) AS fo, ln(lead(s,20) OVER p/s) AS fs FROM sl WINDOW p AS (PARTITION BY original, substitute, window_ ORDER BY date)),
    be AS (SELECT original, substitute, window_, count(*) AS rws, covar_samp(ro,rs)/nullif(var_samp(ro),0) AS beta FROM re GROUP BY 1,2,3),
    fi AS (SELECT re.original, re.substitute, re.window_, count(ro) AS n, corr(ro,rs) AS daily_corr, any_value(beta) AS beta, CASE WHEN count(fo)>20 THEN corr(fo,fs) END AS fwd_corr, stddev_samp(rs-beta*ro)*sqrt(252)*100 AS tracking_error_pct,
        stddev_samp(ro)*sqrt(252)*100 AS ann_vol_o_pct, stddev_samp(rs)*sqrt(252)*100 AS ann_vol_s_pct, avg(ro)*25200 AS ann_ret_o_pct, avg(rs)*25200 AS ann_ret_s_pct
        FROM re JOIN be ON re.original=be.original AND re.substitute=be.substitute AND re.window_=be.window_ WHERE rws>=50 GROUP BY 1,2,3)"""
BASIS_COLUMNS = ("daily_corr", "beta", "fwd_corr", "tracking_error_pct", "ann_vol_o_pct", "ann_vol_s_pct", "ann_ret_o_pct", "ann_ret_s_pct")


@query("X5_basis_risk", BASIS + ' SELECT original, substitute, window_ AS "window", n, ' + cols(*BASIS_COLUMNS, digits=5) + " FROM fi")
def x5(spark, sf):
    sup = driver.table(spark, sf, "supplier")
    name = lambda c: F.concat(F.lit("S"), c.cast("string"))
    pairs = sup.select(name(F.col("s_suppkey")).alias("original"), name(F.col("s_suppkey") - 1).alias("substitute"))
    # The smallest samples repeat prices by chance, so the SQL rounds five digits.
    return out(scr.basis_risk(driver.prices(spark, sf), pairs), "original substitute window n", 5, **{c: c for c in BASIS_COLUMNS})


@query("X6_leaderboard", CAND_SQL + """, lb AS (SELECT seed, annual_return_pct, sharpe, max_drawdown_pct, count(*) OVER (PARTITION BY annual_return_pct, sharpe, max_drawdown_pct) AS n_same FROM s)
    SELECT seed, rank() OVER (ORDER BY sharpe DESC) AS rank_sharpe, rank() OVER (ORDER BY annual_return_pct DESC) AS rank_return, rank() OVER (ORDER BY max_drawdown_pct DESC) AS rank_drawdown, n_same>1 AS duplicate FROM lb""")
def x6(spark, sf):
    cands = texts.parse_candidates(candidate_blocks(spark, sf)).withColumn("board", F.lit("all"))
    return board.leaderboard(cands).select("seed", "rank_sharpe", "rank_return", "rank_drawdown", "duplicate")


WORDS = ("the", "data", "der", "les")
UP, DOWN = ("new", "good", "high", "up"), ("old", "bad", "low", "down")


def any_sql(words, text="lower(title)"):
    return "(" + " OR ".join(f"contains({text},'{w}')" for w in words) + ")"


def sum_sql(words, text="lower(title)"):
    return "(" + "+".join(f"CAST(contains({text},'{w}') AS INTEGER)" for w in words) + ")"


NEWS = "WITH " + HEADLINES_SQL


@query("T1_headline_filter", NEWS + " SELECT url, category, date FROM headlines WHERE " + any_sql(WORDS) + " AND date>=DATE '2024-01-10'")
def t1(spark, sf):
    return news.headline_filter(driver.headlines(spark, sf), WORDS, "2024-01-10").select("url", "category", "date")


@query("T1_headline_filter_shipped", NEWS + " SELECT url, category, date FROM headlines WHERE " + any_sql(news.KEYWORDS))
def t1_shipped(spark, sf):
    return news.headline_filter(driver.headlines(spark, sf)).select("url", "category", "date")


@query("T2_headline_sentiment", NEWS + f" SELECT url, {sum_sql(UP)} AS n_bullish, {sum_sql(DOWN)} AS n_bearish, CASE WHEN {sum_sql(UP)}>{sum_sql(DOWN)} THEN 'up' WHEN {sum_sql(DOWN)}>{sum_sql(UP)} THEN 'down' ELSE 'neutral' END AS sentiment FROM headlines")
def t2(spark, sf):
    return news.headline_sentiment(driver.headlines(spark, sf), UP, DOWN).select("url", "n_bullish", "n_bearish", "sentiment")


DEDUP = NEWS + ", k AS (SELECT *, row_number() OVER (PARTITION BY lower(title) ORDER BY date DESC, url DESC) AS rn FROM headlines)"


@query("T3_headline_dedup", DEDUP + " SELECT url, date FROM k WHERE rn=1")
def t3(spark, sf):
    return news.headline_dedup(driver.headlines(spark, sf), None).select("url", "date")


@query("T3_headline_top20", DEDUP + " SELECT url, date FROM k WHERE rn=1 ORDER BY date DESC, url DESC LIMIT 20")
def t3_top(spark, sf):
    return news.headline_dedup(driver.headlines(spark, sf), 20).select("url", "date")


def signal_rows(spark, sf):
    """A signal log from the predictions, dated a day later; out-of-fold ones have an outcome already."""
    return driver.predictions(spark, sf).select(
        "symbol", F.date_add("date", 1).alias("date"), F.when(F.col("pred") > 0, "BULLISH").otherwise("BEARISH").alias("direction"),
        F.when(F.col("is_oof"), 7.5).alias("outcome_actual"), F.lit(None).cast("boolean").alias("outcome_correct"),
    )


@query("K1_backfill_outcomes", "WITH " + predictions_sql() + ", " + BDAYS_SQL + """, lg AS (SELECT symbol, date+1 AS date, CASE WHEN pred>0 THEN 'BULLISH' ELSE 'BEARISH' END AS direction, CASE WHEN is_oof THEN 7.5 END AS logged FROM predictions),
    px AS (SELECT *, lead(close,10) OVER (PARTITION BY symbol ORDER BY date) AS ex FROM prices), td AS (SELECT symbol, max(date) AS t FROM prices GROUP BY 1),
    ct AS (SELECT td.symbol, b2.date AS c FROM td JOIN bdays b2 ON b2.idx=(SELECT max(b1.idx)-12 FROM bdays b1 WHERE b1.date<=td.t)),
    jn AS (SELECT l.*, p.close, p.ex, ct.c FROM lg l JOIN ct ON ct.symbol=l.symbol ASOF LEFT JOIN px p ON p.symbol=l.symbol AND p.date>=l.date)
    SELECT symbol, date, direction, CASE WHEN logged IS NOT NULL THEN logged WHEN date<=c AND ex IS NOT NULL THEN round((ex/close-1)*100,2)+0.0 END AS outcome_actual,
    CASE WHEN logged IS NULL AND date<=c AND ex IS NOT NULL THEN sign(ex/close-1)=CASE WHEN direction='BULLISH' THEN 1 ELSE -1 END END AS outcome_correct FROM jn""")
def k1(spark, sf):
    done = log.backfill_outcomes(signal_rows(spark, sf), driver.prices(spark, sf))
    return done.select("symbol", "date", "direction", (F.col("outcome_actual") + F.lit(0.0)).alias("outcome_actual"), "outcome_correct")


@query("K1_outcome_stream", ORACLES["K1_backfill_outcomes"])
def k1_stream(spark, sf):
    """The same outcomes from files that arrive in three parts; the stream is started anew for each part."""
    root = shared_folder(spark, "outcome-stream")
    # Written once: each part reads both, and the last join the log again.
    px = materialize(driver.prices(spark, sf), "prices")
    open_rows = materialize(signal_rows(spark, sf), "signals")
    schemas = {"signals": open_rows.schema, "prices": px.schema}
    for part in (F.col("date") < "1994-03-01", F.col("date").between("1994-03-01", "1996-05-31"), F.col("date") > "1996-05-31"):
        open_rows.filter(part & F.col("outcome_actual").isNull()).write.mode("append").parquet(f"{root}/signals")
        px.filter(part).write.mode("append").parquet(f"{root}/prices")
        arriving = [spark.readStream.schema(s).parquet(f"{root}/{name}") for name, s in schemas.items()]
        outcomes.write_outcomes(outcomes.outcome_stream(*arriving), f"{root}/outcomes", f"{root}/progress").awaitTermination()
    filled = outcomes.with_outcomes(open_rows, spark.read.parquet(f"{root}/outcomes"))
    return filled.select("symbol", "date", "direction", (F.col("outcome_actual") + F.lit(0.0)).alias("outcome_actual"), "outcome_correct")


@query("K2_signal_hits", "WITH " + predictions_sql() + """, rl AS (SELECT symbol, date+2 AS date, actual FROM predictions WHERE is_oof), jn AS (SELECT p.symbol, p.date, p.pred, CASE WHEN p.date-r.date<=3 THEN r.actual END AS a FROM predictions p ASOF LEFT JOIN rl r ON r.symbol=p.symbol AND p.date>=r.date)
    SELECT symbol, date, CASE WHEN a IS NULL THEN 'pending' WHEN (pred>0 AND a>0) OR (pred<0 AND a<0) THEN 'hit' ELSE 'miss' END AS mark FROM jn""")
def k2(spark, sf):
    p = driver.predictions(spark, sf)
    realised = p.filter("is_oof").select("symbol", F.date_add("date", 2).alias("date"), "actual")
    return log.signal_hits(p.select("symbol", "date", "pred"), realised, partitions=driver.tasks(spark, sf)).select("symbol", "date", "mark")


@query("K3_latest", "WITH " + prices_sql() + " SELECT symbol, max(date) AS date, arg_max(close,date) AS close FROM prices GROUP BY 1")
def k3(spark, sf):
    return pnl.latest(driver.prices(spark, sf)).select("symbol", "date", "close")
