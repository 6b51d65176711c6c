"""Feature selection F1-F5."""

from __future__ import annotations

from itertools import combinations


from ..functions import indicators as ind
from ..functions.expr import r
from ..operators import selection as sel
from ..sources import driver
from .base import out, prices_sql, query, windows

FEATS = ("r1", "r2", "r5", "r10", "r21", "v")
RAW = "WITH " + prices_sql() + ", f AS (SELECT symbol, date, " + ", ".join(f"ln(close/lag(close,{n}) OVER w) AS r{n}" for n in (1, 2, 5, 10, 21)) + ", ln(volume/lag(volume) OVER w) AS v, ln(lead(close,20) OVER w/close) AS target FROM prices " + windows() + ")"
PAIRS = list(combinations(range(len(FEATS)), 2))
CORR = ", c AS (SELECT symbol, " + ", ".join(f"corr({FEATS[i]},{FEATS[j]}) AS p{i}_{j}" for i, j in PAIRS) + " FROM f GROUP BY symbol), cl AS (" + " UNION ALL ".join(
    f"SELECT symbol, {i} AS i, {j} AS j, '{FEATS[i]}' AS fi, '{FEATS[j]}' AS fj, p{i}_{j} AS rho FROM c" for i, j in PAIRS) + ")"
LIMIT = 0.6


def features(spark, sf):
    df = driver.prices(spark, sf).withColumns(
        {**{f"r{n}": ind.log_return("close", n) for n in (1, 2, 5, 10, 21)}, "v": ind.log_return("volume"), "target": ind.forward_log_return("close", 20)}
    )
    return df.select("symbol", "date", *FEATS, "target")


@query("F1_feature_corr", RAW + CORR + " SELECT symbol, i, j, fi, fj, round(rho,6)+0.0 AS rho FROM cl")
def f1(spark, sf):
    return out(sel.feature_corr(features(spark, sf), FEATS, ["symbol"]), "symbol i j fi fj", rho="rho")


@query("F2_drop_correlated", RAW + CORR + f" SELECT DISTINCT symbol, fj AS feature FROM cl WHERE abs(rho)>{LIMIT} AND NOT isnan(rho)")
def f2(spark, sf):
    return sel.redundant(sel.feature_corr(features(spark, sf), FEATS, ["symbol"]), LIMIT, ["symbol"])


IC = RAW + ", n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn, count(*) OVER (PARTITION BY symbol) AS cnt FROM f), h AS (SELECT * FROM n WHERE rn<=floor(cnt*0.7)), l AS (" + " UNION ALL ".join(
    f"SELECT symbol, '{c}' AS feature, {c} AS value, target FROM h WHERE {c} IS NOT NULL AND target IS NOT NULL" for c in FEATS) + """),
    k AS (SELECT symbol, feature, rank() OVER (PARTITION BY symbol, feature ORDER BY value)+(count(*) OVER (PARTITION BY symbol, feature, value)-1)/2.0 AS rx,
    rank() OVER (PARTITION BY symbol, feature ORDER BY target)+(count(*) OVER (PARTITION BY symbol, feature, target)-1)/2.0 AS ry FROM l),
    ic AS (SELECT symbol, feature, coalesce(CASE WHEN NOT isnan(corr(rx,ry)) THEN corr(rx,ry) END,0) AS ic, count(*) AS n FROM k GROUP BY 1,2)"""


@query("F3_rank_ic", IC + " SELECT symbol, feature, n, round(ic,6)+0.0 AS ic FROM ic")
def f3(spark, sf):
    return out(sel.rank_ic(features(spark, sf), FEATS), "symbol feature n", ic="ic")


IMP = IC + ", imp AS (SELECT symbol, feature, abs(ic) AS abs_ic, row_number() OVER (PARTITION BY symbol ORDER BY round(abs(ic),12) DESC, feature) AS rank FROM ic)"


@query("F4_select_features", IMP + " SELECT symbol, feature FROM imp WHERE rank<=4 AND abs_ic>=0.02")
def f4(spark, sf):
    return sel.importance(sel.rank_ic(features(spark, sf), FEATS), 4).filter("selected").select("symbol", "feature")


@query("F5_importance", IMP + " SELECT symbol, CAST(rank AS INTEGER) AS rank, feature, round(abs_ic,6)+0.0 AS abs_ic, rank<=4 AND abs_ic>=0.02 AS selected FROM imp")
def f5(spark, sf):
    return out(sel.importance(sel.rank_ic(features(spark, sf), FEATS), 4), "symbol rank feature selected", abs_ic="abs_ic")


LONG = [f"r{n}" for n in range(1, 19)]
MATRIX = "WITH " + prices_sql() + ", f AS (SELECT " + ", ".join(f"ln(close/lag(close,{n}) OVER w) AS r{n}" for n in range(1, 19)) + " FROM prices " + windows() + "), c AS (SELECT " + ", ".join(
    f"corr({a},{b}) AS p{i}_{j}" for (i, a), (j, b) in combinations(enumerate(LONG), 2)) + " FROM f) " + " UNION ALL ".join(
    f"SELECT {i} AS i, {j} AS j, '{a}' AS fi, '{b}' AS fj, round(p{i}_{j},6)+0.0 AS rho FROM c" for (i, a), (j, b) in combinations(enumerate(LONG), 2))


@query("F1_feature_corr_matrix", MATRIX)
def f1_matrix(spark, sf):
    """Pooled matrix of a long feature list, with the NULLs at the start of every symbol."""
    df = driver.prices(spark, sf).withColumns({name: ind.log_return("close", n + 1) for n, name in enumerate(LONG)})
    return sel.feature_corr(df, LONG).withColumn("rho", r("rho"))
