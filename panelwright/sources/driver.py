"""The driver's tables as panels: the adapter views every registered query starts from.

Row counts grow with the tables: the supplier panel has one symbol per supplier.  The cell panel has one
symbol per return flag and line status and serves the operators that need a fixed anchor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import dealt, ordered, r, ratio, safe_ln, up_to_now, whole
from ..functions.indicators import forward_log_return

# Prices carry this many decimals, as quotes do.
PRICE_DIGITS = 4

# Line items that one task sorts and keeps at a time, in the key windows of the supplier panel.
ROWS_PER_TASK = 250_000

CELL = "cell"
SUPPLIER = "supplier"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(spark: SparkSession, sf_dir: str, times: int = 1) -> int | None:
    """Tasks for the key windows of the supplier panel, in proportion to the line items; None where a task per core does.

    What a stage of windows keeps per row is several times its shuffled bytes, by which Spark would merge partitions.
    ``times`` says how often the stage repeats each row, as a sweep does.
    """
    n = -(-table(spark, sf_dir, "lineitem").count() * times // ROWS_PER_TASK)
    return n if n > spark.sparkContext.defaultParallelism else None


def symbol_of(kind: str):
    if kind == CELL:
        return F.concat("l_returnflag", "l_linestatus")
    return F.concat(F.lit("S"), F.col("l_suppkey").cast("string"))


def prices(spark: SparkSession, sf_dir: str, kind: str = SUPPLIER, times: int = 1) -> DataFrame:
    """``symbol, date, close, volume``: the daily mean unit price, damped to a walk of about 1 % a day.

    The daily cells are aggregated map-side before the shuffle by (symbol, day); the windows then run over
    at most one row per symbol and day.
    """
    cell = table(spark, sf_dir, "lineitem").groupBy(symbol_of(kind).alias("symbol"), F.to_date("l_shipdate").alias("date")).agg(
        safe_ln(ratio(F.sum("l_extendedprice"), F.sum("l_quantity"))).alias("__x"), F.sum("l_quantity").alias("volume")
    )
    if kind == SUPPLIER:
        cell = dealt(cell, tasks(spark, sf_dir, times), "symbol")
    every = whole("symbol")
    shock = F.lit(0.01) * (F.col("__x") - F.avg("__x").over(every)) / F.stddev_samp("__x").over(every)
    walked = cell.withColumn("__s", shock).withColumn("close", F.sum("__s").over(up_to_now("symbol")))
    return walked.select("symbol", "date", "volume", F.round(F.exp("close") * 100, PRICE_DIGITS).alias("close"))


def bars(spark: SparkSession, sf_dir: str, kind: str = SUPPLIER) -> DataFrame:
    """``symbol, date, open, high, low, close, volume`` from the unit prices of each day's line items."""
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    rank = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").filter(F.col("l_quantity") > 0)
    return rows.groupBy(symbol_of(kind).alias("symbol"), F.to_date("l_shipdate").alias("date")).agg(
        F.min_by(unit, rank).alias("open"), F.max(unit).alias("high"), F.min(unit).alias("low"),
        F.max_by(unit, rank).alias("close"), F.sum("l_quantity").alias("volume"),
    )


def predictions(spark: SparkSession, sf_dir: str, kind: str = SUPPLIER, horizon: int = 20, times: int = 1) -> DataFrame:
    """``strategy, symbol, date, pred, actual, is_oof``: a momentum forecast, every fourth 63-day block out of fold."""
    px = prices(spark, sf_dir, kind, times)
    momentum = F.lit(0.2) * safe_ln(ratio("close", F.lag("close", horizon).over(ordered("symbol"))))
    block = F.floor(F.datediff("date", F.to_date(F.lit("1995-01-01"))) / F.lit(63.0))
    out = px.select(
        F.lit("mom").alias("strategy"), "symbol", "date", r(momentum, 8).alias("pred"),
        r(forward_log_return("close", horizon), 8).alias("actual"), (F.pmod(block, F.lit(4)) == 0).alias("is_oof"),
    )
    return out.dropna("any", subset=["pred", "actual"])


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly (Tuesday) reports per market = order status."""
    report = F.date_add(F.to_date(F.date_trunc("week", "o_orderdate")), 1)
    has = lambda *p: F.count_if(F.col("o_orderpriority").isin(*p)).cast("double")
    return table(spark, sf_dir, "orders").groupBy(report.alias("report_date"), F.col("o_orderstatus").alias("market")).agg(
        has("1-URGENT", "2-HIGH").alias("spec_long"), has("3-MEDIUM").alias("spec_short"),
        has("4-NOT SPECIFIED").alias("comm_long"), has("5-LOW").alias("comm_short"),
        F.count(F.lit(1)).cast("double").alias("open_int"),
    )


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``series, date, value``: mean order value per day."""
    return table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(
        (F.round(F.sum("o_totalprice"), 2) / F.count(F.lit(1))).alias("value")
    ).select(F.lit("order_value").alias("series"), "date", "value")


def interest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``keyword, date, value``: weekly orders per priority."""
    week = F.to_date(F.date_trunc("week", "o_orderdate"))
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("keyword"), week.alias("date")).agg(
        F.count(F.lit(1)).cast("double").alias("value")
    )


def headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("source").alias("category"), F.col("text").alias("title"),
        F.date_add(F.to_date(F.lit("2024-01-01")), (F.col("doc_id") % 30).cast("int")).alias("date"),
        F.col("doc_id").alias("url"),
    )


def fold_predictions(spark: SparkSession, sf_dir: str, kind: str = SUPPLIER) -> DataFrame:
    """``predictions`` under folds 0-8 with fixed fold accuracy and IC; fold 0 fails the filters."""
    fold = F.explode(F.sequence(F.lit(0), F.lit(8))).alias("fold")
    wide = predictions(spark, sf_dir, kind).select("symbol", "date", "actual", F.col("pred").alias("__p"), fold)
    return wide.select(
        "symbol", "date", "fold", "actual", (F.col("__p") * (1 + 0.05 * (F.col("fold") - 4))).alias("pred"),
        F.round(0.38 + 0.04 * F.col("fold"), 6).alias("dir_acc"), F.round(-0.2 + 0.06 * F.col("fold"), 6).alias("ic"),
    )
