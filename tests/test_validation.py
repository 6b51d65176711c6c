"""Trades, chunks and permutations against plain Python."""

from __future__ import annotations

import datetime as dt
from hashlib import md5

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwright.operators import validation as val

BY = ["strategy", "symbol"]


def panel(n=1200, seed=2, symbols=("A", "B"), oof=4, scale=0.02):
    rng = np.random.default_rng(seed)
    days = pd.date_range("2015-01-01", periods=n)
    return pd.concat(
        [
            pd.DataFrame({"strategy": "m", "symbol": s, "date": days.date, "pred": rng.normal(0, scale, n).round(6), "actual": rng.normal(0.002, 0.05, n).round(6), "is_oof": (np.arange(n) // 40) % oof == 0})
            for s in symbols
        ],
        ignore_index=True,
    )


def replay(rows, hold=20, least=0.008):
    free, rets = None, []
    for d, p, a in rows:
        if abs(p) >= least and (free is None or pd.Timestamp(d) >= free):
            rets.append(a if p > 0 else -a)
            free = pd.Timestamp(d) + pd.tseries.offsets.BDay(hold)
    return rets


@pytest.mark.parametrize("hold", [1, 3, 20, 250])
def test_trades_match_the_loop(spark, hold):
    """Weekends, gaps, keys of one day, and successors far away."""
    pdf = panel(500)
    pdf = pdf[np.random.default_rng(1).random(len(pdf)) < 0.7]
    pdf = pd.concat([pdf, pdf.head(1).assign(symbol="C", pred=0.5)], ignore_index=True)
    got = val.non_overlapping(spark.createDataFrame(pdf), hold, mode="long_short")
    for s, own in pdf.groupby("symbol"):
        rets = [r.trade_ret for r in got.filter(F.col("symbol") == s).orderBy("date").collect()]
        assert rets == replay(own[["date", "pred", "actual"]].itertuples(index=False), hold)


def test_no_trades_at_all(spark):
    df = spark.createDataFrame(panel(50)).withColumn("pred", F.lit(0.0))
    assert val.non_overlapping(df).collect() == [] == val.non_overlapping(df.filter("false")).collect()


def draws(own, key, n, seed=42, gap=30):
    """Chunks drawn one at a time until ``n`` have scored."""
    oof = own[own.is_oof]
    block = (pd.to_datetime(oof.date).diff().dt.days > gap).cumsum()
    spans = oof.groupby(block).date.agg(["min", "max", "count"])
    free = own[~own.is_oof].reset_index(drop=True)
    size = int(spans["count"].median())
    out, attempt = [], 0
    while len(out) < n:
        start = int(md5(f"m|{key}|{attempt}|{seed}".encode()).hexdigest()[:15], 16) % (len(free) - size)
        chunk = free.iloc[start : start + size]
        attempt += 1
        if ((spans["min"] <= chunk.date.iloc[-1]) & (spans["max"] >= chunk.date.iloc[0])).any():
            continue
        rets = replay(chunk[["date", "pred", "actual"]].itertuples(index=False))
        if rets:
            out.append((len(rets), round(float(np.mean([r > 0 for r in rets])), 9), round((np.exp(sum(rets)) - 1) * 100, 6), round(chunk.pred.corr(chunk.actual), 9)))
    return out


@pytest.fixture(scope="module")
def sparse():
    """So few signals that most places do not score, and more than one round is drawn."""
    pdf = panel(1400, seed=5)
    rare = np.random.default_rng(8).random(len(pdf)) < 0.02
    return pdf.assign(pred=np.where(rare, pdf.pred.abs() + 0.01, pdf.pred.clip(-0.004, 0.004)))


def test_draws_go_on_until_each_key_is_full(spark, sparse):
    got = val.bootstrap(spark.createDataFrame(sparse), 60).filter("NOT is_oof").toPandas().sort_values(["symbol", "chunk"])
    for s, own in sparse.groupby("symbol"):
        mine = got[got.symbol == s]
        assert list(mine.chunk) == list(range(1, 61)) and set(mine.shortfall) == {0}
        rows = [(int(r.n_trades), round(r.win_rate, 9), round(r.pct_return, 6), round(r.ic, 9)) for r in mine.itertuples()]
        assert rows == draws(own, s, 60)


def test_draws_do_not_depend_on_the_partitions(spark, sparse):
    df = spark.createDataFrame(sparse)
    one, two = (sorted(map(repr, val.bootstrap(d, 20).collect())) for d in (df.coalesce(1), df.repartition(7)))
    assert one == two


def test_a_key_without_places_tells_its_shortfall(spark):
    """No chunk of B has a trade; C is too short for chunks; D is so cut up by its blocks that no chunk is clean."""
    pdf = panel(1200, symbols=("A", "B", "C", "D"))
    at = np.tile(np.arange(1200), 4)
    pdf.loc[(pdf.symbol == "B") & ~pdf.is_oof, "pred"] = 0.0
    pdf = pdf[(pdf.symbol != "C") | (at < 60)]
    d = (pdf.symbol == "D").to_numpy()
    place = np.cumsum(d) - 1
    pdf.loc[d, "is_oof"] = (place[d] % 120) < 80
    got = val.bootstrap(spark.createDataFrame(pdf), 25).filter("NOT is_oof").toPandas()
    assert sorted(got[got.symbol == "A"].chunk) == list(range(1, 26))
    for s in "BD":
        mine = got[got.symbol == s]
        assert len(mine) == 1 and mine.chunk.isna().all() and mine.shortfall.tolist() == [25]
    assert not (got.symbol == "C").any()


def slow_perm(rows, key, n_perm, seed=42):
    rows = sorted(rows, key=lambda r: (not r[1], r[0]))
    n_oof = sum(r[1] for r in rows)
    values = np.array([r[2:] for r in rows])
    seen = values[:n_oof].mean(axis=0) - values[n_oof:].mean(axis=0)
    hits = np.zeros(values.shape[1])
    for p in range(n_perm):
        cut = slice(8 * (p % 4), 8 * (p % 4) + 8)
        order = sorted(range(len(rows)), key=lambda i: (md5(f"m|{key}|{i}|{p // 4}|{seed}".encode()).hexdigest()[cut], i))
        rest = [i for i in order[n_oof:]]
        hits += np.abs(values[order[:n_oof]].mean(axis=0) - values[rest].mean(axis=0)) >= np.abs(seen) - 1e-9
    below = (values[n_oof:] < values[:n_oof].mean(axis=0) - 1e-9).mean(axis=0) * 100
    return hits / n_perm, below


@pytest.mark.parametrize("n_perm", [1, 50, 203])
def test_permutations_match_the_loop(spark, n_perm):
    rng = np.random.default_rng(0)
    rows = [("m", s, i, i < 5 + k, float(rng.normal()), float(rng.integers(0, 3)) / 2, float(rng.normal(k))) for k, s in enumerate("AB") for i in range(45)]
    rows += [("m", "few", i, i < 2, 0.0, 0.0, 0.0) for i in range(40)] + [("m", "A", None, False, None, None, None)]
    df = spark.createDataFrame(rows, "strategy string, symbol string, chunk long, is_oof boolean, ic double, win_rate double, pct_return double")
    got = {r.symbol: r for r in val.perm_test(df, n_perm).collect()}
    assert set(got) == {"A", "B"}
    for s, r in got.items():
        p, below = slow_perm([x[2:] for x in rows if x[1] == s and x[2] is not None], s, n_perm)
        assert [r[f"{m}_perm_p"] for m in val.METRICS] == pytest.approx(list(p), abs=1e-12)
        assert [r[f"{m}_oof_pctile"] for m in val.METRICS] == pytest.approx(list(below), abs=1e-9)
        assert r.n_sig_flags == sum(p < 0.05)


def test_no_python_in_the_plans(spark):
    df = spark.createDataFrame(panel(100))
    samples = spark.createDataFrame([("m", "A", 1, True, 0.0, 0.0, 0.0)], "strategy string, symbol string, chunk long, is_oof boolean, ic double, win_rate double, pct_return double")
    for made in (val.non_overlapping(df), val.oof_validation(df), val.perm_test(samples)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert not any(w in plan for w in ("Python", "Arrow", "Pandas"))


def test_dates_are_days(spark):
    df = spark.createDataFrame([("m", "A", dt.date(2020, 1, 4), 0.5, 0.1)], "strategy string, symbol string, date date, pred double, actual double")
    assert val.non_overlapping(df).first().trade_ret == 0.1


def test_only_keys_are_broadcast(spark, monkeypatch):
    """Draws, places and their rows grow with the input, however small their files; the limit holds the test's tables."""
    plans = []
    monkeypatch.setattr(val, "materialize", lambda df, name, of=val.materialize: plans.append((name, df._jdf.queryExecution().sparkPlan().toString())) or of(df, name))
    val.bootstrap(spark.createDataFrame(panel(1200)), 20).collect()
    joins = {name: plan.count("BroadcastHashJoin") for name, plan in plans}
    assert joins["draws"] == joins["scored-places"] == 0
    assert joins["clean-places"] <= 1  # a key's rows and blocks


def test_chunks_are_not_spread_on_disk(spark, monkeypatch):
    """Keys are dealt once: no draw, place or row of a chunk is exploded, joined or shuffled."""
    plans = []
    monkeypatch.setattr(val, "materialize", lambda df, name, of=val.materialize: plans.append(df._jdf.queryExecution().sparkPlan().toString()) or of(df, name))
    val.bootstrap(spark.createDataFrame(panel(1200)), 20).collect()
    assert not any(w in plan for plan in plans for w in ("Generate", "Join", "Window"))


@pytest.mark.parametrize("at_once", [1, 500])
def test_chunks_in_slices(spark, sparse, monkeypatch, at_once):
    """Slices of one key and of some, repeated days, rows without a forecast, an outcome, a key, a date or a fold mark."""
    from panelwright.operators import chunks

    pdf = pd.concat([sparse, sparse.sample(200, random_state=1)], ignore_index=True)
    df = spark.createDataFrame(pdf)
    at = F.pmod(F.xxhash64("symbol", "date", "pred"), F.lit(40))
    df = df.withColumns({"pred": F.when(at != 0, F.col("pred")), "actual": F.when(at != 1, F.col("actual"))})
    bare = df.limit(9).withColumn("symbol", F.lit(None).cast("string")).union(df.limit(9).withColumn("date", F.lit(None).cast("date"))).union(df.limit(9).withColumn("is_oof", F.lit(None).cast("boolean")))
    whole = sorted(map(repr, val.bootstrap(df, 20).collect()))
    monkeypatch.setattr(chunks, "AT_ONCE", at_once)
    assert sorted(map(repr, val.bootstrap(df.union(bare), 20).collect())) == whole


def test_metrics_of_blocks_match_pandas(spark):
    """Blocks that are constant, short or without a trade; every trade counts, an unknown outcome in neither mean nor sum."""
    pdf = panel(1200, symbols=("A",))
    block = (np.arange(1200) // 160).astype(int)
    pdf.loc[pdf.is_oof & (block == 1), "pred"] = 0.05
    pdf.loc[pdf.is_oof & (block == 2), "pred"] = 0.001
    pdf = pdf[~(pdf.is_oof & (block == 3) & (np.arange(1200) % 160 > 3))]
    got = {r.chunk: r for r in val.bootstrap(spark.createDataFrame(pdf), 5).filter("is_oof").collect()}
    oof = pdf[pdf.is_oof]
    number = (pd.to_datetime(oof.date).diff().dt.days > 30).cumsum()
    want = {}
    for k, own in oof.groupby(number):
        rets = replay(own[["date", "pred", "actual"]].itertuples(index=False))
        if rets and len(own) >= 5:
            ic = own.pred.corr(own.actual) if own.pred.nunique() > 1 else 0.0
            want[k] = (len(own), len(rets), np.mean([r > 0 for r in rets]), (np.exp(sum(rets)) - 1) * 100, ic)
    assert set(got) == set(want) == set(number) - {2, 3}
    for k, w in want.items():
        r = got[k]
        assert (r.n_rows, r.n_trades, r.win_rate, r.pct_return, r.ic) == pytest.approx(w, abs=1e-9) and r.shortfall is None


def test_permutations_with_too_few_rows_below_the_limit(spark, monkeypatch):
    """Without spare rows about half of the permutations have to sort all of them; the result is the same."""
    rng = np.random.default_rng(4)
    rows = [("m", s, i, i < 6, float(rng.normal()), float(rng.integers(0, 3)) / 2, float(rng.normal())) for s in "AB" for i in range(50)]
    df = spark.createDataFrame(rows, "strategy string, symbol string, chunk long, is_oof boolean, ic double, win_rate double, pct_return double")
    usual = sorted(map(repr, val.perm_test(df, 203).collect()))
    monkeypatch.setattr(val, "SPARE", 0)
    assert sorted(map(repr, val.perm_test(df, 203).collect())) == usual


def test_groups_are_dealt_before_they_are_exploded(spark):
    """A group's arrays pass one shuffle, however many permutations there are, and no join."""
    samples = spark.createDataFrame([("m", "A", i, i < 5, 0.1 * i, 0.5, 1.0) for i in range(50)], "strategy string, symbol string, chunk long, is_oof boolean, ic double, win_rate double, pct_return double")
    plan = val.perm_test(samples, 100)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Repartition") == 1 and "Join" not in plan and plan.rindex("Generate") < plan.index("Repartition")
