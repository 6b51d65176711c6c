"""Rotation ledgers against a walk over the days; rows sorted once, not multiplied, read once."""

from __future__ import annotations

import datetime as dt
import math
import random

import pytest

from panelwright.operators import rotation

DAY0 = dt.date(2024, 1, 1)


def sparse_weights(seed: int = 5):
    """Two books of four sleeves that each miss days; one sleeve is primary on some days only, one return is missing."""
    rng, rows = random.Random(seed), []
    for book in ("a", "b"):
        for sleeve in range(4):
            for day in range(40):
                if rng.random() < 0.6:
                    ret = None if rng.random() < 0.1 else rng.uniform(-0.3, 0.3)
                    weight = rng.choice([0.0, 0.0, 0.25, 0.5, -0.25])
                    rows.append((book, DAY0 + dt.timedelta(days=day), f"s{sleeve}", sleeve == 0 or sleeve == 3 and day > 30, weight, ret))
    return rows


def walked(rows, lag, cost, cash, log_returns, hold):
    out = {}
    for book in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == book]
        days, names = sorted({r[1] for r in own}), {r[2] for r in own}
        primary = {r[2] for r in own if r[3]}
        weight, ret = {r[1:3]: r[4] for r in own}, {r[1:3]: r[5] or 0.0 for r in own}
        held = [{s: weight.get((days[i - lag], s), 0.0) if i >= lag else 0.0 for s in names} for i in range(len(days))]
        total = alone = 0.0
        for i, d in enumerate(days):
            before = held[i - 1] if i else dict.fromkeys(names, 0.0)
            gains = {s: h * ret.get((d, s), 0.0) / hold if h > 0 else 0.0 for s, h in held[i].items()}
            invested, turn = sum(held[i].values()), sum(abs(held[i][s] - before[s]) for s in names)
            own_gain = sum(gains[s] for s in primary)
            grow = math.exp if log_returns else (lambda g: 1 + g)
            total += math.log(max(grow(sum(gains.values())) + (1 - invested) * cash / 252 - turn * cost, 1e-12))
            alone += math.log(max(grow(own_gain), 1e-12))
            out[book, d] = (invested, turn, sum(held[i][s] for s in primary), math.exp(total), math.exp(alone))
    return out


@pytest.fixture(scope="module")
def weights(spark):
    kinds = "book string, date date, sleeve string, is_primary boolean, weight double, ret double"
    return spark.createDataFrame(sparse_weights(), kinds)


@pytest.mark.parametrize("lag,cost,cash,returns,hold", [(1, 0.0015, 0.052, "log", 20), (0, 0.0, 0.0, "simple", 20), (3, 0.01, 0.0, "simple", 1)])
def test_ledger_is_the_walk(weights, lag, cost, cash, returns, hold):
    led = rotation.rotation_ledger(weights, lag=lag, cost=cost, cash_rate=cash, returns=returns, hold=hold, capital=1.0)
    got = {(x.book, x.date): (x.invested, x.turnover, x.primary_pos, x.rotation, x.primary_only) for x in led.collect()}
    want = walked(sparse_weights(), lag, cost, cash, returns == "log", hold)
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-12)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_are_sorted_once_and_not_multiplied(weights):
    asked = weights.selectExpr("*", "1 AS rank", "0.01D AS pred", "0.5D AS conf_pct", "weight AS target").drop("weight").repartition(4, "book")
    text = plan(rotation.rotation_ledger(rotation.cascade(asked), lag=1))
    assert "Generate" not in text and "Aggregate" not in text
    assert text.count("Exchange ") == 1
    assert text.count("Sort [") == 1


def test_premium_reads_the_ledger_once(weights):
    prices = weights.selectExpr("book", "date", "1.0D AS close").distinct()
    led = rotation.rotation_ledger(weights)
    assert plan(rotation.premium(led, prices)).count("__before") == plan(led.groupBy("book").agg({"rotation": "max", "primary_only": "max"})).count("__before")
