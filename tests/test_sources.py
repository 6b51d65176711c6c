"""Readers, writers, text parsing and the streaming sink on generated files."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from panelwright.functions.expr import ordered
from panelwright.operators import leaderboard
from panelwright.sources import readers, texts, writers
from panelwright.streaming.signal_feed import append_signal_stream

BLOCKS = """
========================================
Candidate: fwd20_lb30_IC0.5111_DA0.7222_Sh4.04_seed111
  Annual return     :     +31.25%  (calendar-time CAGR)   B&H annual return :     +12.50%  (CAGR)   Annual return    :      +6.75%  (CAGR)
  Sharpe ratio      :      6.125
  Max drawdown      :      -7.25%   B&H max drawdown  :     -44.50%   Max drawdown     :      -4.25%
  Win rate          :       81.5%  (active days)   Win rate         :      88.0%
  Days long         :       55.5%

========================================
Candidate: fwd20_lb30_IC0.4222_DA0.7333_Sh3.03_seed22222
  Annual return     :     +47.75%  (calendar-time CAGR)   B&H annual return :     +18.25%  (CAGR)
  Sharpe ratio      :      8.250
  Max drawdown      :      -9.25%   B&H max drawdown  :     -33.50%
  Win rate          :       79.0%  (active days)
  Days long         :       76.5%

========================================
Candidate: fwd20_lb30_IC0.4222_DA0.7333_Sh3.03_seed7
  Annual return     :     +47.75%  (calendar-time CAGR)   B&H annual return :     +18.25%  (CAGR)
  Sharpe ratio      :      8.250
  Max drawdown      :      -9.25%   B&H max drawdown  :     -33.50%
  Win rate          :       79.0%  (active days)
  Days long         :       76.5%
"""


def test_candidates_and_leaderboard(spark, tmp_path):
    path = tmp_path / "candidate_results.txt"
    path.write_text(BLOCKS)
    df = texts.read_candidates(spark, str(path))
    rows = {x.seed: x for x in df.collect()}
    one = rows[111]
    assert (one.fwd, one.lookback, one.ic, one.dir_acc, one.tag_sharpe) == (20, 30, 0.5111, 0.7222, 4.04)
    assert (one.annual_return_pct, one.bh_annual_return_pct, one.oof_annual_return_pct) == (31.25, 12.50, 6.75)
    assert (one.max_drawdown_pct, one.bh_max_drawdown_pct, one.oof_max_drawdown_pct) == (-7.25, -44.50, -4.25)
    assert (one.win_rate_pct, one.oof_win_rate_pct, one.long_days_pct) == (81.5, 88.0, 55.5)
    assert rows[7].oof_annual_return_pct is None
    board = {x.seed: (x.rank_sharpe, x.rank_drawdown, x.duplicate) for x in leaderboard.leaderboard(df).collect()}
    assert board == {111: (3, 1, False), 22222: (1, 2, True), 7: (1, 2, True)}


def test_key_values(spark, tmp_path):
    (tmp_path / "a.txt").write_text("seed=5\nic_mean=0.3\nconfig=x=y\n")
    (tmp_path / "b.txt").write_text("seed=6\nic_mean=0.1\n")
    got = sorted((x.seed, x.ic_mean, x.config) for x in texts.read_kv(spark, str(tmp_path), ["seed", "ic_mean", "config"]).collect())
    assert got == [("5", "0.3", "x=y"), ("6", "0.1", None)]


def test_positions_in_four_spellings(spark, tmp_path):
    name, code = readers.POSITION_NAME, readers.POSITION_CODE
    files = {
        "legacy.csv": f'"{name}","{readers.ISO_DATE}","Noncommercial Positions-Long (All)","Noncommercial Positions-Short (All)","Commercial Positions-Long (All)","Commercial Positions-Short (All)","Open Interest (All)"\n'
        'Silver,2020-01-07,1,1,1,1,1\nGold futures,2020-01-07,10,4,3,.,20\nGOLD mini,2020-01-07,1,1,1,1,5\n',
        "under.csv": f'"{name}","{readers.SHORT_DATE}",NonComm_Positions_Long_All,NonComm_Positions_Short_All,Comm_Positions_Long_All,Comm_Positions_Short_All,Open_Interest_All\n'
        "Gold,30107,7,2,3,4,11\nGold,991228,8,2,3,4,12\nGold,bad,8,2,3,4,12\n",
        "short.csv": f'"{name}",report_date,Noncommercial Long,Noncommercial Short,Commercial Long,Commercial Short,Open Interest\ngold,2021-02-02,5,1,2,1,9\n',
        "fuzzy.csv": f'"{code}",Report Date,NonCommercial Total Long,NonCommercial Total Short,Commercial Total Long,Commercial Total Short,Open Interest Total (all)\n 088691,2022-03-01,6,1,2,1,8\n067651,2022-03-01,9,9,9,9,9\n',
    }
    for f, text in files.items():
        (tmp_path / f).write_text(text)
    df = readers.read_positions(spark, [str(tmp_path / f) for f in files], "gold", "gold", "088")
    got = {x.report_date: (x.net_spec, x.net_comm, x.open_int) for x in df.collect()}
    assert got == {
        dt.date(2020, 1, 7): (6.0, None, 20.0), dt.date(2003, 1, 7): (5.0, -1.0, 11.0), dt.date(1999, 12, 28): (6.0, -1.0, 12.0),
        dt.date(2021, 2, 2): (4.0, 1.0, 9.0), dt.date(2022, 3, 1): (5.0, 1.0, 8.0),
    }


def test_series_fallback_and_interest(spark, tmp_path):
    (tmp_path / "h.csv").write_text("Day,Note,Tonnes in trust\n2020-01-02,x,5\n2020-01-03,y,n/a\n")
    fallback = spark.createDataFrame([(dt.date(2020, 1, 3), 7.0), (dt.date(2020, 1, 2), 1.0)], "date date, value double")
    got = {x.date.day: x.value for x in readers.read_series(spark, str(tmp_path / "h.csv"), fallback=fallback).collect()}
    assert got == {2: 5.0, 3: 7.0}
    (tmp_path / "i.csv").write_text("week,a,b,isPartial\n2020-01-05,1,3,False\n")
    words = {x.keyword: x.value for x in readers.read_interest(spark, str(tmp_path / "i.csv")).collect()}
    assert words == {"a": 1.0, "b": 3.0, "attention": 2.0}


def test_macro_headers(spark, tmp_path):
    (tmp_path / "m.csv").write_text("date,GPRD,GPRD_ACT,OTHER\n2020-01-05,1,2,9\n")
    got = {x.series: x.value for x in readers.read_macro(spark, str(tmp_path / "m.csv")).collect()}
    assert got == {"GPR": 1.0, "GPRACT": 2.0}


def test_time_slice_reaches_the_scan(spark, sf_dir):
    df = readers.time_slice(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "1997-01-01", "1997-12-31", "l_shipdate").select("l_quantity")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_shipdate" in plan and "LessThan(l_shipdate" in plan
    assert "ReadSchema: struct<l_quantity:double,l_shipdate:timestamp" in plan


def test_log_append_batch_and_stream(spark, tmp_path):
    rows = spark.createDataFrame([("A", dt.date(2020, 1, 1), "BULLISH", 0.1)], "symbol string, date date, direction string, ensemble double")
    log = str(tmp_path / "log")
    writers.append_signal(rows, log)
    writers.append_signal(rows, log)
    assert spark.read.parquet(log).count() == 2
    landing, sink, check = (str(tmp_path / p) for p in ("in", "out", "ck"))
    for day in (1, 2):
        rows.withColumn("date", F.lit(dt.date(2020, 1, day))).write.mode("append").parquet(landing)
        feed = spark.readStream.schema(rows.schema).parquet(landing)
        append_signal_stream(feed, sink, check).awaitTermination(60)
    assert [x.date.day for x in spark.read.parquet(sink).orderBy("date").collect()] == [1, 2]


def test_window_stage_has_one_shuffle_by_symbol(spark, sf_dir):
    from panelwright.sources import driver

    df = driver.prices(spark, sf_dir).withColumn("x", F.avg("close").over(ordered("symbol").rowsBetween(-9, 0)))
    plan = df._jdf.queryExecution().executedPlan().toString()
    # One exchange for the daily cells, one for every window after it.
    assert plan.count("Exchange hashpartitioning") == 2
