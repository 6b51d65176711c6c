"""The table of fitted models: which one a day uses, and what it says."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwright.operators import forecast, splits
from panelwright.plans import flows

FEATURES = ["a", "b"]
CFG = splits.WalkForward(n_folds=4, val_months=1, purge=20, min_train_years=0.5)


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(4)
    parts = []
    for s, n in (("A", 420), ("B", 300), ("short", 40)):
        a, b = rng.normal(size=(2, n))
        y = 0.3 * a - 0.2 * b + rng.normal(0, 0.1, n)
        y[-20:] = np.nan  # not known yet
        a[5] = np.nan
        parts.append(pd.DataFrame({"symbol": s, "date": pd.bdate_range("2015-01-01", periods=n).date, "a": a, "b": b, "target": y}))
    return pd.concat(parts, ignore_index=True)


@pytest.fixture(scope="module")
def df(spark, table):
    made = spark.createDataFrame(table)
    return made.select("symbol", "date", *[F.nanvl(c, F.lit(None)).alias(c) for c in (*FEATURES, "target")])


def direct(rows, ridge=1.0):
    x = np.column_stack([np.ones(len(rows)), rows[FEATURES]])
    return np.linalg.solve(x.T @ x + ridge * np.diag([0, 1, 1]), x.T @ rows["target"])


def test_no_day_uses_a_later_model(df, table):
    folded = splits.assign_folds(df.dropna(), CFG)
    models = forecast.ridge_models(folded, FEATURES)
    scored = forecast.score_by_models(df, models, FEATURES).toPandas()
    fits = models.toPandas()
    assert (scored.trained_until < scored.date).all() and set(scored.symbol) == {"A", "B"}
    for s, own in scored.groupby("symbol"):
        fit, rows = fits[fits.symbol == s], table[table.symbol == s].dropna(subset=FEATURES)
        known = rows.dropna().reset_index(drop=True)
        assert len(own) == (rows.date >= fit.effective.min()).sum()
        for r in own.itertuples():
            used = fit[fit.fold == r.fold].iloc[0]
            # The newest of those in effect, trained on rows whose targets were known by then.
            assert used.effective == fit[fit.effective <= r.date].effective.max()
            last = known.index[known.date == used.trained_until][0]
            assert known.date[known.index[known.date >= r.date][0] if (known.date >= r.date).any() else len(known) - 1] > used.trained_until
            coef = direct(known[: last + 1])
            x = rows[rows.date == r.date].iloc[0]
            assert r.pred == pytest.approx(coef[0] + coef[1] * x.a + coef[2] * x.b, abs=1e-9)


def test_a_later_day_changes_no_forecast(spark, df, table):
    """Models that are in effect stay as they are when rows are added after them."""
    folded = splits.assign_folds(df.dropna(), CFG)
    models = forecast.ridge_models(folded, FEATURES)
    cut = pd.Timestamp("2015-11-30").date()
    early = forecast.score_by_models(df.filter(F.col("date") <= F.lit(cut)), models, FEATURES).collect()
    whole = forecast.score_by_models(df, models, FEATURES).filter(F.col("date") <= F.lit(cut)).collect()
    assert early and sorted(map(repr, early)) == sorted(map(repr, whole))


def test_full_predictions_lay_the_honest_ones_on_top(df):
    got = flows.full_predictions(df, FEATURES, CFG).toPandas()
    oof = forecast.ridge_walk_forward(splits.assign_folds(df.dropna(), CFG), FEATURES).toPandas()
    assert not got.duplicated(["symbol", "date"]).any() and got.is_oof.sum() == len(oof.drop_duplicates(["symbol", "date"]))
    both = got.merge(oof.groupby(["symbol", "date"]).pred.max().rename("honest").reset_index(), on=["symbol", "date"])
    assert np.allclose(both.pred, both.honest)
    assert got.actual.isna().any() and got[got.actual.isna()].pred.notna().all()


def test_no_rows(df):
    none = df.filter("false")
    assert forecast.ridge_models(splits.assign_folds(none, CFG), FEATURES).collect() == []
    assert flows.full_predictions(none, FEATURES, CFG).collect() == []
