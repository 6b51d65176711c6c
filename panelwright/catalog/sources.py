"""Sources and sinks: S1-S14.

Sinks write into a fresh folder under the cluster's shared work folder and are read back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import r
from ..operators import ledger as led
from ..operators.signals import build_signals
from ..session import shared_folder
from ..sources import driver, readers, texts, writers
from .base import INTEREST_SQL, ledger_sql, out, predictions_sql, prices_sql, query, rnd, signals_sql


@query("S1_read_prices", "WITH " + prices_sql() + " SELECT symbol, date, close, volume FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM prices WHERE close>0) WHERE n>=500")
def s1(spark, sf):
    path = shared_folder(spark, "prices")
    driver.prices(spark, sf).withColumn("date", F.to_timestamp("date")).write.parquet(path)
    return readers.read_prices(spark, path, min_rows=500).select("symbol", "date", "close", "volume")


BARS_SQL = """SELECT 'S'||CAST(l_suppkey AS VARCHAR) AS symbol, CAST(l_shipdate AS DATE) AS date, l_extendedprice/l_quantity AS u, l_quantity,
    row_number() OVER (PARTITION BY l_suppkey, CAST(l_shipdate AS DATE) ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS a,
    row_number() OVER (PARTITION BY l_suppkey, CAST(l_shipdate AS DATE) ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_extendedprice DESC) AS b FROM lineitem WHERE l_quantity>0"""


@query("S2_read_bars", "WITH b AS (" + BARS_SQL + """) SELECT symbol, date, max(CASE WHEN a=1 THEN u END) AS open, max(u) AS high, min(u) AS low, max(CASE WHEN b=1 THEN u END) AS close, sum(l_quantity) AS volume
    FROM b GROUP BY 1,2""")
def s2(spark, sf):
    path = shared_folder(spark, "bars")
    driver.bars(spark, sf).withColumn("date", F.to_timestamp("date")).write.parquet(path)
    return readers.read_bars(spark, path).select("symbol", "date", "open", "high", "low", "close", "volume")


@query("S3_read_macro", """WITH w AS (SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS a, count(*) FILTER (WHERE o_orderpriority='1-URGENT') AS b,
    nullif(count(*) FILTER (WHERE o_orderstatus='P'),0) AS c FROM orders GROUP BY 1)
    SELECT * FROM (SELECT 'GPR' AS series, date, CAST(a AS DOUBLE) AS value FROM w UNION ALL SELECT 'GPRACT', date, b FROM w UNION ALL SELECT 'GPRTHR', date, c FROM w) WHERE value IS NOT NULL""")
def s3(spark, sf):
    raw = driver.table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(
        F.count(F.lit(1)).cast("string").alias("GPRD"), F.count_if(F.col("o_orderpriority") == "1-URGENT").cast("string").alias("GPRD_ACT"),
        F.nullif(F.count_if(F.col("o_orderstatus") == "P"), F.lit(0)).cast("string").alias("GPRD_THREAT"),
    )
    path = shared_folder(spark, "macro")
    raw.write.option("header", True).csv(path)
    return readers.read_macro(spark, path, date="day")


def _layouts(spark, sf):
    """Raw weekly reports in three header spellings and date formats, zero counts as text, duplicates included."""
    pos = driver.positions(spark, sf)
    text = lambda c: F.when(F.col(c) == 0, "n/a").otherwise(F.col(c).cast("string"))
    day = F.col("report_date")
    dates = {
        "F": (readers.ISO_DATE, F.date_format(day, "yyyy-MM-dd")), "O": (readers.SHORT_DATE, F.date_format(day, "yyMMdd")),
        "P": ("report_date", F.date_format(day, "yyyy-MM-dd")),
    }
    out_ = []
    for i, (market, (name, fmt)) in enumerate(dates.items()):
        rows = pos.filter(F.col("market") == market)
        half = rows.withColumns({c: F.floor(F.col(c) / 2).cast("double") for c in readers.POSITION_ALIASES})
        both = rows.unionByName(half)
        out_.append(both.select(
            F.concat(F.lit("status "), "market").alias(readers.POSITION_NAME), fmt.alias(name),
            *[text(c).alias(spellings[i]) for c, spellings in readers.POSITION_ALIASES.items()],
        ))
    return out_


@query("S4_read_positions", """WITH p AS (SELECT CAST(date_trunc('week', o_orderdate) AS DATE)+1 AS report_date, 'status '||o_orderstatus AS market,
    nullif(count(*) FILTER (WHERE o_orderpriority IN ('1-URGENT','2-HIGH')),0) AS spec_long, nullif(count(*) FILTER (WHERE o_orderpriority='3-MEDIUM'),0) AS spec_short,
    nullif(count(*) FILTER (WHERE o_orderpriority='4-NOT SPECIFIED'),0) AS comm_long, nullif(count(*) FILTER (WHERE o_orderpriority='5-LOW'),0) AS comm_short, count(*) AS open_int
    FROM orders GROUP BY 1,2) SELECT market, report_date, CAST(spec_long-spec_short AS DOUBLE) AS net_spec, CAST(comm_long-comm_short AS DOUBLE) AS net_comm, CAST(open_int AS DOUBLE) AS open_int,
    """ + rnd("(spec_long-spec_short)/(open_int+1e-9)", "spec_oi_ratio") + " FROM p")
def s4(spark, sf):
    paths = []
    for i, layout in enumerate(_layouts(spark, sf)):
        paths.append(shared_folder(spark, f"positions{i}"))
        layout.write.option("header", True).csv(paths[-1])
    pos = readers.read_positions(spark, paths, name_contains="status")
    return out(pos, "market report_date net_spec net_comm open_int", spec_oi_ratio="spec_oi_ratio")


@query("S5_read_series", """WITH a AS (SELECT CAST(o_orderdate AS DATE) AS date, CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY 1),
    b AS (SELECT CAST(l_shipdate AS DATE) AS date, sum(l_quantity) AS value FROM lineitem GROUP BY 1) SELECT date, coalesce(a.value, b.value) AS value FROM a FULL JOIN b USING (date)""")
def s5(spark, sf):
    held = driver.table(spark, sf, "orders").groupBy(
        F.to_date("o_orderdate").alias("day")
    ).agg(F.lit("x").alias("note"), F.count(F.lit(1)).alias("Total Holdings"))
    path = shared_folder(spark, "holdings")
    held.write.option("header", True).csv(path)
    volume = driver.table(spark, sf, "lineitem").groupBy(F.to_date("l_shipdate").alias("date")).agg(F.sum("l_quantity").alias("value"))
    return readers.read_series(spark, path, fallback=volume)


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("S6_read_interest", "WITH " + INTEREST_SQL + " SELECT keyword, date, " + rnd("value", "value") + " FROM interest UNION ALL SELECT 'attention', date, round(avg(value),6)+0.0 FROM interest GROUP BY date")
def s6(spark, sf):
    wide = driver.interest(spark, sf).groupBy("date").pivot("keyword", PRIORITIES).agg(F.first("value"))
    path = shared_folder(spark, "interest")
    wide.write.option("header", True).csv(path)
    return out(readers.read_interest(spark, path), "keyword date", value="value")


@query("S7_read_predictions", """WITH x AS (SELECT o_orderstatus AS strategy, o_orderpriority AS symbol, o_orderdate + to_microseconds(o_orderkey) AS ts,
    o_totalprice/1e6-0.25 AS pred, CASE WHEN o_custkey%7<>0 THEN o_totalprice/2e6 END AS actual FROM orders)
    SELECT strategy, symbol, CAST(ts AS DATE) AS date, pred, actual FROM (SELECT *, row_number() OVER (PARTITION BY strategy, symbol, CAST(ts AS DATE) ORDER BY ts DESC) AS rn FROM x WHERE actual IS NOT NULL) WHERE rn=1""")
def s7(spark, sf):
    raw = driver.table(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("strategy"), F.col("o_orderpriority").alias("symbol"),
        F.timestamp_micros(F.unix_micros(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey")).alias("date"),
        (F.col("o_totalprice") / 1e6 - 0.25).alias("pred"),
        F.when(F.col("o_custkey") % 7 != 0, F.col("o_totalprice") / 2e6).alias("actual"), F.lit(False).alias("is_oof"),
    )
    path = shared_folder(spark, "raw-predictions") + ".csv"
    raw.write.option("header", True).option("timestampFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path)
    return readers.read_predictions(spark, path).select("strategy", "symbol", "date", "pred", "actual")


@query("S8_write_predictions", "WITH " + predictions_sql() + " SELECT strategy, symbol, date, pred, actual, is_oof FROM predictions")
def s8(spark, sf):
    path = shared_folder(spark, "predictions")
    writers.write_predictions(driver.predictions(spark, sf), path)
    return spark.read.parquet(path).select("strategy", "symbol", "date", "pred", "actual", "is_oof")


@query("S9_write_ledger", "WITH " + predictions_sql() + ", " + signals_sql() + ", " + ledger_sql() + " SELECT strategy, symbol, date, " + ", ".join(
    rnd(e, n, 2) for e, n in (("capital", "portfolio"), ("position", "position"), ("capital*position", "stock"), ("capital*(1-position)", "cash"))) + " FROM ledger")
def s9(spark, sf):
    path = shared_folder(spark, "ledger")
    writers.write_ledger(led.ledger(build_signals(driver.predictions(spark, sf))), path)
    back = spark.read.parquet(path)
    return out(back, "strategy symbol date", 2, portfolio="portfolio", position="position", stock="stock", cash="cash")


@query("S10_write_table", "WITH " + predictions_sql() + " SELECT symbol, count(*) AS n, " + rnd("avg(pred)", "mean_pred", 4) + ", " + rnd("stddev_samp(actual)", "std_actual", 4) + " FROM predictions GROUP BY 1")
def s10(spark, sf):
    path = shared_folder(spark, "table")
    stats = driver.predictions(spark, sf).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.avg("pred").alias("mean_pred"), F.stddev_samp("actual").alias("std_actual")
    )
    writers.write_table(stats, path)
    back = spark.read.csv(path, header=True, schema="symbol string, n bigint, mean_pred double, std_actual double")
    return out(back, "symbol n", 4, mean_pred="mean_pred", std_actual="std_actual")


@query("S11_append_signal", "WITH " + predictions_sql() + """ SELECT symbol, date, CASE WHEN pred>0 THEN 'BULLISH' ELSE 'BEARISH' END AS direction, pred AS ensemble, CAST(NULL AS DOUBLE) AS outcome_actual FROM predictions""")
def s11(spark, sf):
    path = shared_folder(spark, "log")
    rows = driver.predictions(spark, sf).select(
        "symbol", "date", F.when(F.col("pred") > 0, "BULLISH").otherwise("BEARISH").alias("direction"), F.col("pred").alias("ensemble"), "is_oof"
    )
    writers.append_signal(rows.filter("is_oof"), path)
    writers.append_signal(rows.filter("NOT is_oof"), path)
    return spark.read.parquet(path).select("symbol", "date", "direction", "ensemble", "outcome_actual")


def candidate_blocks(spark, sf):
    """Result blocks as text, one per supplier, from the supplier's predictions."""
    stats = driver.predictions(spark, sf).groupBy("symbol").agg(
        F.round(F.sum("actual") * 100, 2).alias("ret"), F.round(F.avg("pred") * 1000, 3).alias("sharpe"),
        F.round(F.min("actual") * 100, 2).alias("dd"), F.round(F.max("actual") * 100, 2).alias("bh"), F.count(F.lit(1)).alias("n"),
    )
    fmt = (
        "\nCandidate: fwd20_lb30_IC0.4120_DA0.7235_Sh3.19_seed%d\n  Annual return     :  %+.2f%%  (calendar-time CAGR)   B&H annual return :  %+.2f%%  (CAGR)   Annual return    :  %+.2f%%  (CAGR)\n"
        "  Sharpe ratio      :  %.3f\n  Max drawdown      :  %.2f%%\n  Win rate          :  %.1f%%  (active days)\n  Days long         :  50.6%%\n"
    )
    seed = F.expr("substring(symbol, 2)").cast("bigint")
    return stats.select(F.format_string(fmt, seed, "ret", "bh", "dd", "sharpe", "dd", F.lit(75.5)).alias("value"))


CAND_SQL = "WITH " + predictions_sql() + """, s AS (SELECT CAST(substr(symbol,2) AS INTEGER) AS seed, round(sum(actual)*100,2)+0.0 AS annual_return_pct, round(avg(pred)*1000,3)+0.0 AS sharpe, round(min(actual)*100,2)+0.0 AS max_drawdown_pct, round(max(actual)*100,2)+0.0 AS bh FROM predictions GROUP BY symbol)"""


@query("S12_read_candidates", CAND_SQL + " SELECT seed, 20 AS fwd, 30 AS lookback, 0.412::DOUBLE AS ic, 0.7235::DOUBLE AS dir_acc, annual_return_pct, bh AS bh_annual_return_pct, max_drawdown_pct AS oof_annual_return_pct, sharpe, max_drawdown_pct, 75.5::DOUBLE AS win_rate_pct, 50.6::DOUBLE AS long_days_pct FROM s")
def s12(spark, sf):
    path = shared_folder(spark, "candidates")
    candidate_blocks(spark, sf).select(F.concat(F.lit(texts.SEPARATOR), "value").alias("value")).write.text(path)
    got = texts.read_candidates(spark, path)
    return got.select(
        "seed", "fwd", "lookback", *[r(c).alias(c) for c in (
            "ic", "dir_acc", "annual_return_pct", "bh_annual_return_pct", "oof_annual_return_pct", "sharpe", "max_drawdown_pct", "win_rate_pct", "long_days_pct")]
    )


@query("S13_read_kv", "WITH " + predictions_sql() + " SELECT symbol, CAST(count(*) AS VARCHAR) AS n, CAST(min(date) AS VARCHAR) AS first_date FROM predictions GROUP BY 1")
def s13(spark, sf):
    stats = driver.predictions(spark, sf).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("d"))
    lines = stats.select("symbol", F.explode(F.array(F.concat(F.lit("n="), F.col("n").cast("string")), F.concat(F.lit("first_date="), F.col("d").cast("string")))).alias("value"))
    path = shared_folder(spark, "notes")
    # One file per symbol, by a fixed number of tasks: Spark would merge the few bytes into one, which opens all files in turn.
    tasks = driver.tasks(spark, sf) or spark.sparkContext.defaultParallelism
    lines.repartition(tasks, "symbol").write.partitionBy("symbol").text(path)
    got = texts.read_kv(spark, path, ["n", "first_date"])
    return got.select(F.regexp_extract("file", "symbol=([^/]+)", 1).alias("symbol"), "n", "first_date")


@query("S14_time_slice", "SELECT CAST(l_shipdate AS DATE) AS date, count(*) AS n, round(sum(l_extendedprice),2)+0.0 AS amount FROM lineitem WHERE l_shipdate>=TIMESTAMP '1997-01-01' AND l_shipdate<TIMESTAMP '1998-07-01' GROUP BY 1")
def s14(spark, sf):
    part = readers.time_slice(driver.table(spark, sf, "lineitem"), "1997-01-01", "1998-06-30", "l_shipdate")
    return part.groupBy(F.to_date("l_shipdate").alias("date")).agg(F.count(F.lit(1)).alias("n"), r(F.sum("l_extendedprice"), 2).alias("amount"))
