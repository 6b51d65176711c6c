"""Ranks among earlier rows against pandas and against plain counting."""

from __future__ import annotations

import time

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelwright.operators import signals
from panelwright.operators.order_stats import percentiles, prefix_counts, rank_so_far


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=70), st.data())
def test_counts_in_prefixes(ranks, data):
    ends = data.draw(st.lists(st.integers(0, len(ranks)), max_size=20))
    asked = data.draw(st.lists(st.integers(0, 9), min_size=len(ends), max_size=len(ends)))
    ranks = np.array([min(r, len(ranks) - 1) for r in ranks], np.int64)
    below, upto = prefix_counts(ranks, np.array(ends, np.int64), np.array(asked, np.int64).clip(0, max(len(ranks) - 1, 0)))
    for e, a, b, u in zip(ends, asked, below, upto, strict=True):
        a = min(a, max(len(ranks) - 1, 0))
        assert (b, u) == ((ranks[:e] < a).sum(), (ranks[:e] <= a).sum())


@pytest.mark.parametrize("window", [None, 1, 7, 100, 500])
@pytest.mark.parametrize("holes", [0.0, 0.2])
def test_percentiles_match_pandas(window, holes):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 40, 300).astype(float)
    x[rng.random(300) < holes] = np.nan
    need = 1 if window is None else min(window, 5)
    s = pd.Series(x)
    want = (s.expanding(need) if window is None else s.rolling(window, min_periods=need)).rank(pct=True)
    np.testing.assert_allclose(percentiles(x, window, need), want, rtol=1e-12)


def test_no_rows_and_no_values():
    assert percentiles(np.array([])).size == 0 and np.isnan(percentiles(np.full(5, np.nan), 3)).all()


def test_a_symbol_of_100_000_rows(spark):
    n = 100_000
    days = F.date_add(F.lit("1700-01-01").cast("date"), F.col("id").cast("int"))
    df = spark.range(n).select(F.lit("m").alias("strategy"), F.lit("A").alias("symbol"), days.alias("date"), F.round(F.sin(F.col("id") * 7919.0), 4).alias("pred"))
    start = time.perf_counter()
    got = signals.confidence(df, "expanding").orderBy("date").toPandas().conf_pct.to_numpy()
    last = signals.confidence(df, "trailing", window=50_000).orderBy("date").toPandas().conf_pct.to_numpy()
    assert time.perf_counter() - start < 60
    x = np.abs(df.orderBy("date").toPandas().pred.to_numpy())
    for i in (0, 1, 777, 50_000, n - 1):
        for seen, value in ((x[: i + 1], got[i]), (x[max(0, i - 49_999) : i + 1], last[i])):
            assert value == pytest.approx(((seen < x[i]).sum() + ((seen == x[i]).sum() + 1) / 2) / len(seen), abs=1e-12)


def test_no_list_over_a_frame(spark):
    df = spark.createDataFrame([("m", "A", 1, 0.5)], "strategy string, symbol string, date int, pred double")
    for mode in ("trailing", "expanding"):
        assert "collect_list" not in signals.confidence(df, mode)._jdf.queryExecution().toString()
    nulls = spark.createDataFrame([("A", 1, None), ("A", 2, 3.0), (None, 1, 1.0), ("A", 3, 2.0)], "symbol string, date int, x double")
    got = {(r.symbol, r.date): r.p for r in rank_so_far(nulls, {"p": "x"}).collect()}
    assert got == {("A", 1): None, ("A", 2): 1.0, (None, 1): 1.0, ("A", 3): 0.5}
