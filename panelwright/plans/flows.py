"""End-to-end flows built from the operators; each is lineage only, up to the caller's action."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import indicators as ind
from ..functions.expr import dealt, r
from ..operators import ensemble as ens
from ..operators import forecast as fc
from ..operators import ledger as led
from ..operators import rotation as rot
from ..operators import screen as scr
from ..operators import signals as sig
from ..operators import splits
from ..operators import validation as val
from ..operators.calendar import panel_align
from ..operators.panel import complete_cases, overlay
from ..operators.rolling import rolling_z_all
from ..session import materialize


def momentum_predictions(prices: DataFrame, horizon: int = 20, scale: float = 0.01) -> DataFrame:
    """Aligned panel, z-score of the 20-row return as forecast, realised forward return."""
    panel = panel_align(prices.select("symbol", "date", "close"))
    raw = panel.withColumns({"z": ind.log_return("close", horizon), "actual": ind.forward_log_return("close", horizon)})
    scored = rolling_z_all(raw.select("symbol", "date", "z", "actual"), ["z"])
    # Rounding makes equal forecasts tie whatever the order of summation.
    preds = scored.select(
        F.lit("momentum").alias("strategy"), "symbol", "date", r(F.col("z") * scale, 8).alias("pred"), r("actual", 8).alias("actual")
    )
    return preds.dropna("any")


def backtest(preds: DataFrame, lag: int = 1, hold: int = 20, min_signal: float = 0.008, by: Sequence[str] = led.BY) -> DataFrame:
    """Execution lag, signals and ledger of a prediction table."""
    return led.ledger(sig.build_signals(sig.exec_lag(preds, lag, by), min_signal, by=by), by, hold)


def momentum_backtest(prices: DataFrame) -> DataFrame:
    """Volatility-normalised momentum, from prices to performance per symbol."""
    return led.perf(backtest(momentum_predictions(prices)))


def backtest_report(preds: DataFrame, prices: DataFrame, lag: int = 1, partitions: int | None = None) -> DataFrame:
    """Performance, benchmark and excess return per symbol."""
    performance = led.perf(backtest(preds, lag))
    return led.alpha(performance, led.benchmark_perf(led.benchmark(prices, preds, partitions=partitions)))


def validation_report(preds: DataFrame, n_boot: int = 300, n_perm: int = 1000) -> DataFrame:
    """Out-of-fold metrics beside the resampling verdict."""
    honest = val.oof_validation(preds)
    verdict = val.perm_test(val.bootstrap(preds, n_boot), n_perm)
    return honest.join(verdict.select("strategy", "symbol", "n_sig_flags", "verdict"), ["strategy", "symbol"], "left")


def train_evaluate(
    table: DataFrame, features: Sequence[str], cfg: splits.WalkForward = splits.WalkForward(), ridge: float = 1.0
) -> tuple[DataFrame, DataFrame]:
    """Out-of-fold forecasts of a feature table (with or without folds) and the gated summary per symbol."""
    folded = table if "role" in table.columns else splits.assign_folds(complete_cases(table, features, "target"), cfg)
    oof = fc.ridge_walk_forward(folded, features, ridge=ridge)
    metrics = fc.forecast_metrics(oof, ["symbol", "fold"]).withColumn("dir_acc", F.round("dir_acc", 9))
    summary = fc.fold_summary(metrics)
    # Limits are compared to nine digits, so that a value on a limit passes whatever the order of summation.
    summary = fc.gate(summary.withColumns({c: F.round(c, 9) for c, kind in summary.dtypes if kind == "double"}))
    return oof, summary


def full_predictions(
    table: DataFrame, features: Sequence[str], cfg: splits.WalkForward = splits.WalkForward(), ridge: float = 1.0,
    partitions: int | None = None,
) -> DataFrame:
    """``symbol, date, fold, pred, actual, is_oof`` of every day that a model was in effect on.

    The out-of-fold forecast where there is one, the last model trained before the day elsewhere; recent days, whose
    target is not known yet, included.  ``partitions`` sets the tasks of the windows by symbol.
    """
    # Written once: the models, their folds and the days each read the features again.
    table = dealt(materialize(table.select("symbol", "date", *features, "target"), "features"), partitions, "symbol")
    folded = splits.assign_folds(complete_cases(table, features, "target"), cfg)
    models = materialize(fc.ridge_models(folded, features, ridge=ridge), "models")
    oof = fc.ridge_walk_forward(folded, features, ridge=ridge, models=models).select("symbol", "date", "pred")
    days = fc.score_by_models(table, models, features, partitions=partitions)
    laid = overlay(days, oof, ["symbol", "date"])
    held = oof.select("symbol", "date", F.lit(True).alias("is_oof")).distinct()
    known = table.groupBy("symbol", "date").agg(F.max("target").alias("actual"))
    out = laid.join(held, ["symbol", "date"], "left").join(known, ["symbol", "date"], "left")
    return out.select("symbol", "date", "fold", "pred", "actual", F.coalesce("is_oof", F.lit(False)).alias("is_oof"))


def live_signals(fold_preds: DataFrame, fold_metrics: DataFrame, n: int = 60) -> DataFrame:
    """The last ``n`` ensemble signals per symbol."""
    weights = ens.ensemble_weights(fold_metrics)
    merged = ens.ensemble(fold_preds, weights)
    # Rounding makes equal forecasts tie whatever the order of summation.
    return ens.recent_signals(merged.withColumn("ensemble", F.round("ensemble", 9)), n)


def rotation_report(sleeves: DataFrame, prices: DataFrame, priority: str = "confidence", lag: int = 1) -> DataFrame:
    """Yearly returns of the rotation, the primary book and buy-and-hold."""
    weights = rot.cascade(sleeves, priority)
    books = rot.rotation_ledger(weights, lag=lag, cost=rot.ROTATION_COST, cash_rate=rot.ROTATION_CASH_RATE, returns="log", hold=20)
    return rot.yearly(books, prices)


def diversifier_report(panel: DataFrame, anchor: str, k: int = 10, min_dollar_volume: float = scr.MIN_DOLLAR_VOLUME) -> DataFrame:
    """The best liquid candidates per regime of the anchor."""
    return scr.top_k(scr.screen(panel, anchor, min_dollar_volume=min_dollar_volume), k=k)
