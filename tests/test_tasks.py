"""Tasks of the key windows grow with the line items, with the same results."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from panelwright.catalog import QUERIES
from panelwright.functions.expr import r
from panelwright.operators import rolling
from panelwright.sources import driver

NAMES = ("I14_macd", "G1_confidence_oof", "L7_benchmark", "L8_alpha", "E2_backtest_report", "K2_signal_hits", "R3_wide_weights", "R3_rotation_ledger", "R3_rotation_replay")


@pytest.mark.parametrize("name", NAMES)
def test_tasks_follow_the_rows(spark, sf_dir, monkeypatch, name):
    few = QUERIES[name](spark, sf_dir)
    one = sorted(map(repr, few.collect()))
    monkeypatch.setattr(driver, "ROWS_PER_TASK", 250)
    n = driver.tasks(spark, sf_dir)
    assert n == -(-driver.table(spark, sf_dir, "lineitem").count() // 250)
    many = QUERIES[name](spark, sf_dir)
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert f", {3 * n if name[0] == 'R' else n}), REPARTITION_BY_NUM" in plan
    assert sorted(map(repr, many.collect())) == one


def test_tasks_of_the_sweep_follow_its_grid(spark, sf_dir, monkeypatch):
    one = sorted(map(repr, QUERIES["L9_sweep"](spark, sf_dir).collect()))
    monkeypatch.setattr(driver, "ROWS_PER_TASK", 2_500)
    many = QUERIES["L9_sweep"](spark, sf_dir)
    n = -(-10 * driver.table(spark, sf_dir, "lineitem").count() // 2_500)
    assert f", {n}), REPARTITION_BY_NUM" in many._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(repr, many.collect())) == one


def test_notes_are_written_by_several_tasks(spark, sf_dir, monkeypatch):
    from pathlib import Path

    from panelwright.sources import texts

    seen, read = [], texts.read_kv
    monkeypatch.setattr(texts, "read_kv", lambda s, path, keys: seen.append(path) or read(s, path, keys))
    n = len(QUERIES["S13_read_kv"](spark, sf_dir).collect())
    files = [f.name for f in Path(seen[0]).glob("symbol=*/part-*")]
    assert len(files) == n
    assert len({f.split("-")[1] for f in files}) > 1


def test_full_predictions_read_the_line_items_once(spark, sf_dir):
    text = QUERIES["E1_full_predictions"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in text and "l_shipdate" not in text


def test_outcome_stream_writes_its_inputs_once(spark, sf_dir):
    text = QUERIES["K1_outcome_stream"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in text and "l_shipdate" not in text


def test_tasks_of_the_feature_table_follow_the_rows(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(driver, "ROWS_PER_TASK", 250)
    text = QUERIES["F0_all_blocks_metals"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert f", {driver.tasks(spark, sf_dir)}), REPARTITION_BY_NUM" in text


def _walks(lengths):
    rng = np.random.default_rng(7)
    at = np.concatenate([np.arange(n) for n in lengths])
    x = np.concatenate([100 * np.exp(np.cumsum(rng.normal(0, 0.01, n))) for n in lengths])
    return pd.DataFrame({"symbol": np.repeat([f"S{i}" for i in range(len(lengths))], lengths), "at": at, "a": x, "b": rng.normal(size=len(x))})


def test_sliding_statistics_of_many_symbols_at_once():
    df = _walks([1, 9, 40, 253, 252, 700, 3])
    df.loc[[60, 400, 401], "b"] = np.nan
    df.loc[500:530, "b"] = 0.1
    at, a, b, by = df["at"].to_numpy(), df.a.to_numpy(), df.b.to_numpy(), df.groupby("symbol", sort=False)
    got = {k: rolling.ROLLED[k](at, 20, *c) for k, c in {"mean": [b], "sum": [b], "min": [b], "std": [b], "corr": [a, b], "lag": [b], "macd": [a]}.items()}
    roll = lambda how: by.b.transform(lambda s: getattr(s.rolling(20), how)())
    want = {k: roll(k) for k in ("mean", "sum", "min", "std")} | {"lag": by.b.shift(20)}
    line = by.a.transform(lambda s: s.ewm(span=12, adjust=False).mean() - s.ewm(span=26, adjust=False).mean())
    want["macd"] = line - line.groupby(df.symbol, sort=False).transform(lambda s: s.ewm(span=20, adjust=False).mean())
    corr = by[["a", "b"]].apply(lambda g: g.a.rolling(20).corr(g.b)).droplevel(0)
    want["corr"] = corr.where(roll("std") > 1e-9)
    for k, w in want.items():
        np.testing.assert_allclose(got[k], w.to_numpy(), rtol=1e-7, atol=1e-9, err_msg=k)
    scores = by.b.transform(lambda s: (s - s.rolling(252, min_periods=126).mean()) / (s.rolling(252, min_periods=126).std() + 1e-9))
    np.testing.assert_allclose(rolling.rolling_scores(b, at, 252, 126), scores.to_numpy(), rtol=1e-7, atol=1e-9)


def test_groups_that_go_on_in_the_next_batch(spark):
    df = _walks([30, 1, 25, 70, 2])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8")
    try:
        rows = rolling.rolled_columns(spark.createDataFrame(df).repartition(1, "symbol"), {"m": ("mean", 5, ["b"])}, order="at").toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = rows.sort_values(["symbol", "at"], ignore_index=True)
    np.testing.assert_allclose(rows.m, rows.groupby("symbol").b.transform(lambda s: s.rolling(5).mean()), atol=1e-12)


def test_rounding_in_the_pass_is_that_of_spark(spark):
    x = np.concatenate([np.arange(-200, 200) / 4e4, [0.00005, -0.00005, 1.00005, 2.5e-5, 1e17, -1e30, 12345678.90125, -1e-9, 0.0, 3e-320]])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, x double")
    want = df.select("i", r("x", 4).alias("y")).orderBy("i").toPandas()["y"].to_numpy()
    assert np.array_equal(rolling.half_up(x, 4), want)


def test_sliding_features_are_no_window_frames(spark, sf_dir):
    text = QUERIES["F0_all_blocks_metals"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" not in text and "specifiedwindowframe(RowFrame, -199" not in text
    assert text.count("MapInArrow") == 2 and "REPARTITION_BY_COL" not in text.split("MapInArrow")[0]
