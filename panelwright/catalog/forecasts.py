"""Splits, forecasts and ensembles M1-M15."""

from __future__ import annotations

from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from ..functions import indicators as ind
from ..functions.expr import r
from ..operators import ensemble as ens
from ..operators import forecast as fc
from ..operators import panel as pnl
from ..operators import splits
from ..plans import flows
from ..sources import driver
from .base import cols, out, predictions_sql, prices_sql, query, rnd, windows
from .panels import FOLDS, FOLDS_SQL

PX = "WITH " + prices_sql()
PRED = "WITH " + predictions_sql()


@query("M1_wf_splits", PX + ", " + FOLDS_SQL + " SELECT symbol, n, CAST(fold AS INTEGER) AS fold, train_end, val_start, val_end FROM folds")
def m1(spark, sf):
    return splits.wf_splits(driver.prices(spark, sf), FOLDS)


@query("M2_exclude_before", PX + ", " + FOLDS_SQL + """, ri AS (SELECT symbol, date, row_number() OVER (PARTITION BY symbol ORDER BY date)-1 AS i FROM prices)
    SELECT r.symbol, CAST(f.fold AS INTEGER) AS fold, count(*) FILTER (WHERE i<train_end) AS n_train, count(*) FILTER (WHERE i>=val_start) AS n_val FROM ri r JOIN folds f ON r.symbol=f.symbol
    AND ((i<train_end AND date>=DATE '1996-01-01') OR (i>=val_start AND i<val_end)) GROUP BY 1,2""")
def m2(spark, sf):
    rows = splits.assign_folds(driver.prices(spark, sf), FOLDS, exclude_before="1996-01-01")
    return rows.groupBy("symbol", "fold").agg(F.count_if(F.col("role") == "train").alias("n_train"), F.count_if(F.col("role") == "val").alias("n_val"))


SEQ = ", f AS (SELECT symbol, date, CAST(ln(close) AS FLOAT) AS a, CAST(volume AS FLOAT) AS b FROM prices), q AS (SELECT symbol, date, list([a,b]) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS s FROM f)"


@query("M3_sequences", PX + SEQ + " SELECT symbol, date, len(s) AS n, round(CAST(s[1][2] AS DOUBLE),4)+0.0 AS first_volume, round(CAST(s[30][2] AS DOUBLE),4)+0.0 AS last_volume, round(CAST(s[1][1] AS DOUBLE),4)+0.0 AS first_log FROM q WHERE len(s)=30")
def m3(spark, sf):
    px = driver.prices(spark, sf).withColumn("lc", F.ln("close"))
    seq = splits.sequences(px, ["lc", "volume"], 30)
    at = lambda i, j: F.element_at(F.element_at("sequence", i), j)
    return seq.select("symbol", "date", F.size("sequence").cast("bigint").alias("n"), r(at(1, 2), 4).alias("first_volume"), r(at(30, 2), 4).alias("last_volume"), r(at(1, 1), 4).alias("first_log"))


FEATS = ("r1", "r5", "r21", "vol20")


def regression_rows(spark, sf):
    df = driver.prices(spark, sf).withColumns({"r1": ind.log_return("close"), "r5": ind.log_return("close", 5), "r21": ind.log_return("close", 21)})
    df = df.withColumns({"vol20": ind.rolling_vol("r1", 20), "target": ind.smoothed_target("close")})
    return pnl.complete_cases(df.select("symbol", "date", *FEATS, "target"), FEATS, "target")


TWO = ("r5", "vol20")


def two_feature_folds(spark, sf):
    df = driver.prices(spark, sf).withColumns({"r1": ind.log_return("close"), "r5": ind.log_return("close", 5)})
    df = df.withColumns({"vol20": ind.rolling_vol("r1", 20), "target": ind.smoothed_target("close")})
    return splits.assign_folds(df.select("symbol", "date", *TWO, "target").dropna("any"), FOLDS)


# Ridge with two features in closed form: the penalty is added to both sums of squares around the means.
RIDGE_SQL = (
    PX + ", r0 AS (SELECT *, ln(close/lag(close) OVER w) AS r1, ln(close/lag(close,5) OVER w) AS r5, (" + "+".join(f"ln(lead(close,{h}) OVER w/close)" for h in (17, 18, 19, 20)) + ")/4 AS y FROM prices " + windows()
    + "), r AS (SELECT symbol, date, r5, y, CASE WHEN count(r1) OVER w20>=20 THEN stddev_samp(r1) OVER w20 END*sqrt(252) AS v FROM r0 " + windows(20) + "), c AS (SELECT * FROM r WHERE r5 IS NOT NULL AND v IS NOT NULL AND y IS NOT NULL), "
    + FOLDS_SQL.replace("FROM prices", "FROM c") + """, ri AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date)-1 AS i FROM c),
    su AS (SELECT ri.symbol, f.fold, avg(r5) AS ma, avg(v) AS mb, avg(y) AS my, var_pop(r5)*count(*)+1 AS aa, var_pop(v)*count(*)+1 AS bb, covar_pop(r5,v)*count(*) AS ab, covar_pop(r5,y)*count(*) AS ay, covar_pop(v,y)*count(*) AS vy
        FROM ri JOIN folds f ON ri.symbol=f.symbol AND i<train_end GROUP BY 1,2),
    fit AS (SELECT *, (ay*bb-vy*ab)/(aa*bb-ab*ab) AS ca, (vy*aa-ay*ab)/(aa*bb-ab*ab) AS cb FROM su),
    oof AS (SELECT ri.symbol, ri.date, CAST(f.fold AS INTEGER) AS fold, my+ca*(r5-ma)+cb*(v-mb) AS pred, y AS actual FROM ri JOIN folds f ON ri.symbol=f.symbol AND i>=val_start AND i<val_end JOIN fit ON fit.symbol=f.symbol AND fit.fold=f.fold)"""
)


@query("M4_walk_forward", RIDGE_SQL + " SELECT symbol, date, fold, " + cols("pred", "actual") + " FROM oof")
def m4(spark, sf):
    """Ridge per (symbol, fold); the tests compare longer feature lists with a direct solve."""
    return out(fc.ridge_walk_forward(two_feature_folds(spark, sf), TWO), "symbol date fold", pred="pred", actual="actual")


# With one feature and no penalty the ridge is the least-squares line, which SQL has.
@query("M4_walk_forward_line", PX + ", " + "r AS (SELECT symbol, date, ln(close/lag(close,5) OVER w) AS x, (" + "+".join(f"ln(lead(close,{h}) OVER w/close)" for h in (17, 18, 19, 20)) + ")/4 AS y FROM prices " + windows() + "), c AS (SELECT * FROM r WHERE x IS NOT NULL AND y IS NOT NULL), "
       + FOLDS_SQL.replace("FROM prices", "FROM c") + """, ri AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date)-1 AS i FROM c),
    fit AS (SELECT ri.symbol, f.fold, regr_slope(y,x) AS b, regr_intercept(y,x) AS a FROM ri JOIN folds f ON ri.symbol=f.symbol AND i<train_end GROUP BY 1,2)
    SELECT ri.symbol, ri.date, CAST(f.fold AS INTEGER) AS fold, """ + rnd("a+b*x", "pred") + ", " + rnd("y", "actual") + " FROM ri JOIN folds f ON ri.symbol=f.symbol AND i>=val_start AND i<val_end JOIN fit ON fit.symbol=f.symbol AND fit.fold=f.fold")
def m4_line(spark, sf):
    df = driver.prices(spark, sf).withColumns({"x": ind.log_return("close", 5), "target": ind.smoothed_target("close")})
    folded = splits.assign_folds(df.select("symbol", "date", "x", "target").dropna("any"), FOLDS)
    return out(fc.ridge_walk_forward(folded, ["x"], ridge=0.0), "symbol date fold", pred="pred", actual="actual")


@query("M4_walk_forward_pooled")
def m4_pooled(spark, sf):
    """One pooled model per fold through the library's own regressors."""
    folded = splits.assign_folds(regression_rows(spark, sf), FOLDS)
    return out(fc.ml_walk_forward(folded, FEATS, LinearRegression(regParam=0.01), FOLDS.n_folds), "symbol date fold", 5, pred="pred", actual="actual")


# Trials: each month of a symbol's predictions is a fold, each weekday a start.
TRIAL_SQL = """tr AS (SELECT symbol, CAST(year(date)-1995 AS INTEGER) AS fold, CAST(isodow(date)-1 AS INTEGER) AS start, round(corr(pred,actual),8) AS ic, round(avg(CASE WHEN sign(pred)=sign(actual) THEN 1.0 ELSE 0.0 END),8) AS dir_acc FROM predictions GROUP BY 1,2,3),
    t5 AS (SELECT *, ic+2*greatest(dir_acc-0.5,0) AS score FROM tr WHERE NOT isnan(ic) AND ic IS NOT NULL)"""


def trials(spark, sf):
    p = driver.predictions(spark, sf)
    hit = (F.signum("pred") == F.signum("actual")).cast("double")
    t = p.groupBy("symbol", (F.year("date") - 1995).alias("fold"), F.weekday("date").alias("start")).agg(F.round(F.corr("pred", "actual"), 8).alias("ic"), F.round(F.avg(hit), 8).alias("dir_acc"))
    return t.filter("ic IS NOT NULL AND NOT isnan(ic)")


@query("M5_pick_best", PRED + ", " + TRIAL_SQL + """, a AS (SELECT *, row_number() OVER (PARTITION BY symbol, fold ORDER BY start<3 DESC, score DESC, start) AS re, row_number() OVER (PARTITION BY symbol, fold ORDER BY score DESC, start) AS ra FROM t5),
    e AS (SELECT *, start<3 AND ic>=0.15 AND dir_acc>=0.60 AS done FROM a WHERE re=1),
    b AS (SELECT a.symbol, a.fold, a.ic, a.dir_acc, a.score, a.start, e.done AS early_exit FROM a JOIN e ON a.symbol=e.symbol AND a.fold=e.fold WHERE (e.done AND a.re=1) OR (NOT e.done AND a.ra=1)),
    p AS (SELECT *, (ic<-0.10 OR dir_acc<0.40) AND fold>=1 AS abandoned FROM b), s AS (SELECT symbol, min(fold) AS stop FROM p WHERE abandoned GROUP BY 1)
    SELECT p.symbol, p.fold, p.start, early_exit, abandoned, ic, score FROM p LEFT JOIN s ON p.symbol=s.symbol WHERE stop IS NULL OR p.fold<=stop""")
def m5(spark, sf):
    return fc.pick_best(trials(spark, sf)).select("symbol", "fold", "start", "early_exit", "abandoned", "ic", "score")


@query("M6_holdout", PX + " SELECT symbol, part, count(*) AS n, min(date) AS first_date FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY symbol ORDER BY date)<=floor(count(*) OVER (PARTITION BY symbol)*0.85) THEN 'train' ELSE 'test' END AS part FROM prices) GROUP BY 1,2")
def m6(spark, sf):
    return splits.holdout(driver.prices(spark, sf)).groupBy("symbol", "part").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"))


METRICS_SQL = """y AS (SELECT *, CAST(year(date)-1995 AS INTEGER) AS fold FROM predictions),
    rk AS (SELECT *, rank() OVER (PARTITION BY symbol, fold ORDER BY pred)+(count(*) OVER (PARTITION BY symbol, fold, pred)-1)/2.0 AS rp, rank() OVER (PARTITION BY symbol, fold ORDER BY actual)+(count(*) OVER (PARTITION BY symbol, fold, actual)-1)/2.0 AS ra FROM y),
    mt AS (SELECT symbol, fold, avg(abs(pred-actual)) AS mae, sqrt(avg((pred-actual)*(pred-actual))) AS rmse, avg(CASE WHEN sign(pred)=sign(actual) THEN 1.0 ELSE 0.0 END) AS dir_acc, CASE WHEN NOT isnan(corr(rp,ra)) THEN corr(rp,ra) END AS ic,
    avg(sign(pred)*actual)/(stddev_pop(sign(pred)*actual)+1e-9)*sqrt(25.2) AS sharpe, count(*) AS n FROM rk GROUP BY 1,2)"""
MET = PRED + ", " + METRICS_SQL
NAMES = ("mae", "rmse", "dir_acc", "ic", "sharpe")


def metrics(spark, sf):
    p = driver.predictions(spark, sf).withColumn("fold", F.year("date") - 1995)
    return fc.forecast_metrics(p, ["symbol", "fold"])


@query("M7_forecast_metrics", MET + " SELECT symbol, fold, n, " + cols("mae", "rmse", "dir_acc", "ic") + ", " + rnd("sharpe", "sharpe", 5) + " FROM mt")
def m7(spark, sf):
    m = metrics(spark, sf)
    return m.select("symbol", "fold", "n", *[r(c).alias(c) for c in NAMES[:4]], r("sharpe", 5).alias("sharpe"))


@query("M8_label_metrics", MET + """ SELECT symbol, fold, CASE WHEN round(ic,9)>=0.30 THEN 'exceptional' WHEN round(ic,9)>=0.10 THEN 'strong' WHEN round(ic,9)>=0.05 THEN 'useful' WHEN round(ic,9)>=0 THEN 'weak positive' ELSE 'negative' END AS ic_label,
    CASE WHEN round(sharpe,6)>=2 THEN 'excellent' WHEN round(sharpe,6)>=1 THEN 'good' WHEN round(sharpe,6)>=0.5 THEN 'moderate' WHEN round(sharpe,6)>=0 THEN 'weak' ELSE 'negative' END AS sharpe_label,
    CASE WHEN round(dir_acc,9)<0.40 OR round(ic,9)<-0.15 THEN 'EXCL' WHEN round(dir_acc,9)<0.52 OR round(ic,9)<0 THEN 'WEAK' WHEN round(dir_acc,9)<0.65 AND round(ic,9)<0.10 THEN 'OK' ELSE 'STRONG' END AS fold_flag FROM mt""")
def m8(spark, sf):
    m = metrics(spark, sf).withColumns({"ic": F.round("ic", 9), "dir_acc": F.round("dir_acc", 9), "sharpe": F.round("sharpe", 6)})
    return fc.label_metrics(m).select("symbol", "fold", "ic_label", "sharpe_label", "fold_flag")


SUM = MET + ", m9 AS (SELECT * FROM mt), sm AS (SELECT symbol, " + ", ".join(f"avg({m}) AS {m}_mean, stddev_pop({m}) AS {m}_std, min({m}) AS {m}_min, max({m}) AS {m}_max" for m in NAMES) + ", CAST(arg_min(fold, (-round(dir_acc,9), fold)) AS INTEGER) AS best_fold, count(*) AS n_folds FROM m9 GROUP BY 1)"


def summary(spark, sf):
    m = metrics(spark, sf).withColumn("dir_acc", F.round("dir_acc", 9))
    return fc.fold_summary(m)


@query("M9_fold_summary", SUM + " SELECT symbol, best_fold, n_folds, " + cols(*[f"{m}_{s}" for m in NAMES for s in ("mean", "std", "min", "max")], digits=5) + " FROM sm")
def m9(spark, sf):
    return out(summary(spark, sf), "symbol best_fold n_folds", 5, **{f"{m}_{s}": f"{m}_{s}" for m in NAMES for s in ("mean", "std", "min", "max")})


RULES = (("ic_mean", ">=", 0.0), ("dir_acc_mean", ">=", 0.5), ("ic_std", "<=", 0.30), ("ic_min", ">=", -0.2), ("sharpe_mean", ">=", 0.0), ("dir_acc_min", ">=", 0.40))


@query("M10_gate", SUM + " SELECT symbol, n_failed=0 AS passes, n_failed FROM (SELECT symbol, " + "+".join(f"CASE WHEN round({n},9){o}{v} THEN 0 ELSE 1 END" for n, o, v in RULES) + " AS n_failed FROM sm)")
def m10(spark, sf):
    s = summary(spark, sf)
    s = s.withColumns({n: F.round(n, 9) for n, _, _ in RULES})
    return fc.gate(s, RULES).select("symbol", "passes", F.size("failed").alias("n_failed"))


@query("M11_best_run", MET + ", b AS (SELECT fold AS config, symbol AS seed, round(ic,9) AS ic_mean FROM mt WHERE ic IS NOT NULL), rb AS (SELECT *, row_number() OVER (PARTITION BY config ORDER BY ic_mean DESC, CAST(substr(seed,2) AS BIGINT)) AS rn FROM b) SELECT config, CAST(substr(seed,2) AS BIGINT) AS seed, " + cols("ic_mean") + " FROM rb WHERE rn=1")
def m11(spark, sf):
    runs = metrics(spark, sf).filter("ic IS NOT NULL").select(F.col("fold").alias("config"), F.expr("substring(symbol, 2)").cast("bigint").alias("seed"), F.round("ic", 9).alias("ic_mean"))
    return out(fc.best_run(runs), "config seed", ic_mean="ic_mean")


@query("M12_score_history", PX + ", f AS (SELECT symbol, date, ln(close/lag(close) OVER w) AS r1 FROM prices " + windows() + "), q AS (SELECT symbol, date, avg(r1) OVER p AS m, count(r1) OVER p AS n FROM f WHERE r1 IS NOT NULL WINDOW p AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)) SELECT symbol, date, "
       + rnd("m", "pred", 5) + " FROM q WHERE n=30")
def m12(spark, sf):
    """The scoring hook with a mean-of-window model, which SQL can restate."""
    px = driver.prices(spark, sf).withColumn("r1", ind.log_return("close")).filter("r1 IS NOT NULL")
    seq = splits.sequences(px.select("symbol", "date", "r1"), ["r1"], 30)
    return out(fc.score_history(seq, lambda x: x.astype("float64").mean(axis=(1, 2))), "symbol date", 5, pred="pred")


MODELS_SQL = RIDGE_SQL + """, md AS (SELECT fit.*, ri.date AS effective FROM fit JOIN folds f ON fit.symbol=f.symbol AND fit.fold=f.fold JOIN ri ON ri.symbol=f.symbol AND ri.i=f.val_start),
    sd AS (SELECT r.symbol, r.date, CAST(md.fold AS INTEGER) AS fold, my+ca*(r5-ma)+cb*(v-mb) AS pred, y FROM r ASOF JOIN md ON md.symbol=r.symbol AND md.effective<=r.date WHERE r5 IS NOT NULL AND v IS NOT NULL)"""


def two_features(spark, sf):
    """Every day with its two features; the last days have no target yet."""
    df = driver.prices(spark, sf).withColumns({"r1": ind.log_return("close"), "r5": ind.log_return("close", 5)})
    return df.withColumns({"vol20": ind.rolling_vol("r1", 20), "target": ind.smoothed_target("close")}).select("symbol", "date", *TWO, "target")


@query("M12_history_by_models", MODELS_SQL + " SELECT symbol, date, fold, " + cols("pred") + " FROM sd")
def m12_models(spark, sf):
    """Every day by the last ridge model trained before it."""
    models = fc.ridge_models(two_feature_folds(spark, sf), TWO)
    return out(fc.score_by_models(two_features(spark, sf), models, TWO), "symbol date fold", pred="pred")


@query("E1_full_predictions", MODELS_SQL + """ SELECT sd.symbol, sd.date, sd.fold, round(coalesce(oof.pred, sd.pred),6)+0.0 AS pred, round(y,6)+0.0 AS actual, oof.pred IS NOT NULL AS is_oof
    FROM sd LEFT JOIN oof ON oof.symbol=sd.symbol AND oof.date=sd.date""")
def e1_full(spark, sf):
    return out(flows.full_predictions(two_features(spark, sf), TWO, FOLDS, partitions=driver.tasks(spark, sf)), "symbol date fold is_oof", pred="pred", actual="actual")


FOLD_SQL = """fp AS (SELECT symbol, date, CAST(g AS INTEGER) AS fold, pred*(1+0.05*(g-4)) AS pred FROM predictions, range(9) t(g)),
    fm AS (SELECT symbol, CAST(g AS INTEGER) AS fold, round(0.38+0.04*g,6)::DOUBLE AS dir_acc, round(-0.2+0.06*g,6)::DOUBLE AS ic FROM (SELECT DISTINCT symbol FROM predictions), range(9) t(g)),
    kp AS (SELECT *, greatest(dir_acc-0.5,0.01) AS acc, exp(2.0*(row_number() OVER (PARTITION BY symbol ORDER BY fold)-1)/nullif(count(*) OVER (PARTITION BY symbol)-1,0)) AS rec FROM fm WHERE dir_acc>=0.40 AND ic>=-0.15),
    ew AS (SELECT *, 0.6*acc/sum(acc) OVER (PARTITION BY symbol)+0.4*rec/sum(rec) OVER (PARTITION BY symbol) AS weight FROM kp),
    en AS (SELECT f.symbol, f.date, sum(weight*f.pred) AS ensemble, count(*) AS n_folds, sum(CASE WHEN f.pred>0 THEN 1 ELSE 0 END) AS up, sum(CASE WHEN f.pred<0 THEN 1 ELSE 0 END) AS dn FROM fp f JOIN ew ON f.symbol=ew.symbol AND f.fold=ew.fold GROUP BY 1,2)"""
FOLD = PRED + ", " + FOLD_SQL


def fold_weights(spark, sf):
    folds = driver.fold_predictions(spark, sf).groupBy("symbol", "fold").agg(F.max("dir_acc").alias("dir_acc"), F.max("ic").alias("ic"))
    return ens.ensemble_weights(folds)


def ensembles(spark, sf):
    return ens.ensemble(driver.fold_predictions(spark, sf).select("symbol", "date", "fold", "pred"), fold_weights(spark, sf))


@query("M13_ensemble_weights", FOLD + " SELECT symbol, fold, " + cols("weight") + " FROM ew")
def m13(spark, sf):
    return out(fold_weights(spark, sf), "symbol fold", weight="weight")


@query("M14_ensemble", FOLD + " SELECT symbol, date, n_folds, CASE WHEN ensemble>0 THEN 'BULLISH' ELSE 'BEARISH' END AS direction, " + cols("ensemble") + ", " + rnd("CASE WHEN ensemble>0 THEN up WHEN ensemble<0 THEN dn ELSE n_folds-up-dn END*1.0/n_folds", "agreement") + ", "
       + rnd("(exp(ensemble)-1)*100", "pct_ret", 4) + ", " + rnd("least(abs(ensemble)/0.05,1)", "confidence", 5) + " FROM en")
def m14(spark, sf):
    e = ensembles(spark, sf)
    return e.select("symbol", "date", "n_folds", "direction", r("ensemble").alias("ensemble"), r("agreement").alias("agreement"), r("pct_ret", 4).alias("pct_ret"), r("confidence", 5).alias("confidence"))


@query("M15_recent_signals", FOLD + """, b AS (SELECT * FROM (SELECT symbol, date, round(ensemble,9) AS ensemble, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn FROM en) WHERE rn<=60),
    c AS (SELECT *, (rank() OVER (PARTITION BY symbol ORDER BY abs(ensemble))-1)/count(*) OVER (PARTITION BY symbol) AS conf_pct FROM b) SELECT symbol, date, """ + cols("conf_pct") + ", " + rnd("CASE WHEN abs(ensemble)>=0.008 AND ensemble>0 THEN (CASE WHEN conf_pct<0.25 THEN 0.25 WHEN conf_pct<0.5 THEN 0.5 WHEN conf_pct<0.75 THEN 0.75 ELSE 1 END) ELSE 0 END", "position") + " FROM c")
def m15(spark, sf):
    e = ensembles(spark, sf).withColumn("ensemble", F.round("ensemble", 9))
    return out(ens.recent_signals(e), "symbol date", conf_pct="conf_pct", position="position")
