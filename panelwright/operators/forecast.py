"""Fitting, scoring and judging forecasts."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Estimator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import EPS, TRADING_DAYS, as_list, avg_rank, col, correlation
from ..session import materialize
from .panel import asof_join, keep_by_max


def ridge_models(
    folded: DataFrame, features: Sequence[str], target: str = "target", ridge: float = 1.0,
    by: Sequence[str] = ("symbol",), date: str = "date",
) -> DataFrame:
    """``by, fold, coef, trained_until, effective``: one ridge regression per (key, fold) as a table of models.

    A fit needs only the cross products of the training rows.  They are sums, so Spark combines them
    map-side and a key with any number of rows never meets in one task; each small system is solved where
    its sums land.  ``coef`` is the intercept and a slope per feature.  A model is in effect from the first validation
    day of its fold: the gap that the folds keep before it covers the days its targets look ahead.  Folds without
    training or validation rows have no model.
    """
    by, features = as_list(by), list(features)
    k = len(features)
    train, val = F.col("role") == "train", F.col("role") == "val"
    terms = [F.lit(1.0), *[F.col(f) for f in features]]
    over = lambda c: F.sum(F.when(train, c))
    upper = [over(terms[i] * terms[j]) for i in range(k + 1) for j in range(i, k + 1)]
    right = [over(t * F.col(target)) for t in terms]
    clean = folded.dropna("any", subset=[*features, target])
    sums = clean.groupBy(*by, "fold").agg(
        F.array(*upper).alias("xtx"), F.array(*right).alias("xty"), F.max(F.when(train, F.col(date))).alias("trained_until"),
        F.min(F.when(val, F.col(date))).alias("effective"),
    ).filter("trained_until IS NOT NULL AND effective IS NOT NULL")
    iu = np.triu_indices(k + 1)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def solve(xtx: pd.Series, xty: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(xtx, xty):
            m = np.zeros((k + 1, k + 1))
            m[iu] = a
            m = m + np.triu(m, 1).T + ridge * np.diag([0.0] + [1.0] * k)
            out.append(np.linalg.lstsq(m, np.asarray(b), rcond=None)[0].tolist())
        return pd.Series(out)

    return sums.select(*by, "fold", solve("xtx", "xty").alias("coef"), "trained_until", "effective")


def linear(coef: str, features: Sequence[str]) -> Column:
    """Intercept and slopes applied to the features of the row."""
    pred = F.element_at(coef, 1)
    for i, f in enumerate(features):
        pred = pred + F.element_at(coef, i + 2) * F.col(f)
    return pred


def ridge_walk_forward(
    folded: DataFrame, features: Sequence[str], target: str = "target", ridge: float = 1.0,
    by: Sequence[str] = ("symbol",), date: str = "date", models: DataFrame | None = None,
) -> DataFrame:
    """Out-of-fold forecasts of each (key, fold)'s ridge regression (M4): its coefficients joined to the validation rows.

    ``models`` are those of ``ridge_models`` on the same folds, where they are at hand.
    """
    by, features = as_list(by), list(features)
    models = ridge_models(folded, features, target, ridge, by, date) if models is None else models
    val = folded.dropna("any", subset=[*features, target]).filter("role = 'val'").join(models.select(*by, "fold", "coef"), [*by, "fold"])
    return val.select(*by, date, "fold", linear("coef", features).alias("pred"), F.col(target).alias("actual"))


def score_by_models(
    rows: DataFrame, models: DataFrame, features: Sequence[str], by: Sequence[str] = ("symbol",), date: str = "date",
    partitions: int | None = None,
) -> DataFrame:
    """Every day's forecast by the last model in effect on it: ``by, date, fold, trained_until, pred``.

    The model is found by an as-of join on the table of models, so no day uses one that was trained on later days.  Rows
    need no target; those with a missing feature and days before the first model have no forecast and are left out.
    """
    by, features = as_list(by), list(features)
    known = rows.dropna("any", subset=features).select(*by, date, *features)
    in_effect = models.select(*by, F.col("effective").alias(date), "trained_until", "fold", "coef")
    scored = asof_join(known, in_effect, ["trained_until", "fold", "coef"], by, date, partitions=partitions).filter("coef IS NOT NULL")
    return scored.select(*by, date, "fold", "trained_until", linear("coef", features).alias("pred"))


def ml_walk_forward(
    folded: DataFrame, features: Sequence[str], estimator: Estimator, n_folds: int, target: str = "target",
    keys: Sequence[str] = ("symbol", "date"),
) -> DataFrame:
    """Pooled fit of any ``pyspark.ml`` regressor per fold, forecasts on its validation rows (M4).

    The driver loops over the handful of folds; every fit and transform is distributed.  The rows are written
    once, partitioned by fold and role, so that no pass of a fit recomputes the features or reads another
    fold's rows.
    """
    clean = folded.dropna("any", subset=[*features, target]).select(*keys, *features, target, "fold", "role")
    rows = materialize(clean, "folds", ("fold", "role"))
    assemble = VectorAssembler(inputCols=list(features), outputCol="features")
    out = None
    for fold in range(n_folds):
        part = assemble.transform(rows.filter(F.col("fold") == fold)).withColumn("label", F.col(target))
        train = part.filter("role = 'train'")
        if not train.head(1):
            continue
        model = estimator.fit(train.select("features", "label"))
        scored = model.transform(part.filter("role = 'val'")).select(
            *keys, "fold", F.col("prediction").alias("pred"), F.col("label").alias("actual")
        )
        out = scored if out is None else out.unionByName(scored)
    if out is None:
        raise ValueError("no fold has training rows")
    return out


def score_history(
    sequences: DataFrame, predict: Callable[[np.ndarray], np.ndarray], keys: Sequence[str] = ("symbol", "date"),
    extra: Sequence[str] = (),
) -> DataFrame:
    """Scores every day with a user's model: ``predict`` maps (rows, look-back, features) to rows."""
    kept = [*keys, *extra]
    schema = T.StructType([sequences.schema[c] for c in kept] + [T.StructField("pred", T.DoubleType())])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.stack([np.stack(s) for s in pdf["sequence"]]).astype("float32") if len(pdf) else None
            out = pdf[kept].copy()
            out["pred"] = np.asarray(predict(x), dtype=float).reshape(-1) if x is not None else []
            yield out

    return sequences.select(*kept, "sequence").mapInPandas(score, schema)


def forecast_metrics(preds: DataFrame, by: Sequence[str], horizon: int = 10) -> DataFrame:
    """MAE, RMSE, directional accuracy, Spearman IC and the sign strategy's Sharpe per group (M7)."""
    by = as_list(by)
    ranked = preds.withColumns({"__rp": avg_rank(by, "pred"), "__ra": avg_rank(by, "actual")})
    err = F.col("pred") - F.col("actual")
    gain = F.signum("pred") * F.col("actual")
    ic = correlation("__rp", "__ra")
    return ranked.groupBy(*by).agg(
        F.avg(F.abs(err)).alias("mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.avg((F.signum("pred") == F.signum("actual")).cast("double")).alias("dir_acc"),
        F.when(~F.isnan(ic), ic).alias("ic"),
        (F.avg(gain) / (F.stddev_pop(gain) + EPS) * math.sqrt(TRADING_DAYS / horizon)).alias("sharpe"),
        F.count(F.lit(1)).alias("n"),
    )


# Least coefficient and least Sharpe ratio of each label, the best first; labels below zero; accuracy and
# coefficient under which a fold is left out, weak or ordinary, with their flags.
IC_LABELS = ((0.30, "exceptional"), (0.10, "strong"), (0.05, "useful"), (0.0, "weak positive"))
SHARPE_LABELS = ((2.0, "excellent"), (1.0, "good"), (0.5, "moderate"), (0.0, "weak"))
BELOW = "negative"
EXCLUDED, WEAK, ORDINARY, BEST = (0.40, -0.15, "EXCL"), (0.52, 0.0, "WEAK"), (0.65, 0.10, "OK"), "STRONG"


def _graded(value: Column, labels: Sequence[tuple[float, str]]) -> Column:
    """The first label whose limit the value reaches."""
    return F.coalesce(*[F.when(value >= least, label) for least, label in labels], F.lit(BELOW))


def ic_label(ic) -> Column:
    """(M8)"""
    return _graded(col(ic), IC_LABELS)


def sharpe_label(sharpe) -> Column:
    return _graded(col(sharpe), SHARPE_LABELS)


def fold_flag(dir_acc, ic, min_da: float = EXCLUDED[0], min_ic: float = EXCLUDED[1]) -> Column:
    """Regime flag of a fold (M8)."""
    da, ic = col(dir_acc), col(ic)
    return (
        F.when((da < min_da) | (ic < min_ic), EXCLUDED[2])
        .when((da < WEAK[0]) | (ic < WEAK[1]), WEAK[2])
        .when((da < ORDINARY[0]) & (ic < ORDINARY[1]), ORDINARY[2])
        .otherwise(BEST)
    )


def label_metrics(metrics: DataFrame) -> DataFrame:
    return metrics.withColumns(
        {"ic_label": ic_label("ic"), "sharpe_label": sharpe_label("sharpe"), "fold_flag": fold_flag("dir_acc", "ic")}
    )


def fold_summary(metrics: DataFrame, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Mean, population deviation and range of each metric over folds, and the most accurate fold (M9)."""
    aggs = []
    for m in ("dir_acc", "ic", "sharpe", "mae", "rmse"):
        aggs += [
            F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"), F.min(m).alias(f"{m}_min"), F.max(m).alias(f"{m}_max"),
        ]
    best = F.max_by("fold", F.struct(F.col("dir_acc"), -F.col("fold"))).alias("best_fold")
    return metrics.groupBy(*as_list(by)).agg(*aggs, best, F.count(F.lit(1)).alias("n_folds"))


# The candidate rules (summary column, comparison, limit).
GATE_RULES = (
    ("ic_mean", ">=", 0.30),
    ("dir_acc_mean", ">=", 0.67),
    ("ic_std", "<=", 0.30),
    ("ic_min", ">=", -0.05),
    ("sharpe_mean", ">=", 3.00),
    ("dir_acc_min", ">=", 0.45),
)


def gate(summary: DataFrame, rules: Sequence[tuple[str, str, float]] = GATE_RULES) -> DataFrame:
    """``passes`` and the list of failed rules per candidate."""
    fails = []
    for name, op, limit in rules:
        ok = F.col(name) >= limit if op == ">=" else F.col(name) <= limit
        fails.append(F.when(~F.coalesce(ok, F.lit(False)), F.lit(f"{name}{op}{limit:g}")))
    failed = F.array_compact(F.array(*fails))
    return summary.withColumn("failed", failed).withColumn("passes", F.size("failed") == 0)


def best_run(runs: DataFrame, config: Sequence[str] = ("config",), metric: str = "ic_mean", tiebreak: str = "seed") -> DataFrame:
    """The run with the highest mean IC per configuration."""
    return keep_by_max(runs, as_list(config), [F.col(metric), -F.col(tiebreak)])


# Starts that decide alone, early-exit and abandon limits.
MIN_STARTS = 3
EXIT_IC, EXIT_DA, ABANDON_IC, ABANDON_DA = 0.15, 0.60, -0.10, 0.40


def pick_best(trials: DataFrame, by: Sequence[str] = ("symbol",), fold: str = "fold", start: str = "start", min_starts: int = MIN_STARTS, max_starts: int | None = None) -> DataFrame:
    """Best trial per fold by IC + 2 * max(0, accuracy - 0.5), earliest start on a tie (M5).

    The first ``min_starts`` starts decide unless their best misses the early-exit limits; then all count, or the first
    ``max_starts``.  A
    fold after the first whose best is poor is marked, and the folds after it in the same run are dropped.
    """
    by = as_list(by)
    keys = [*by, fold]
    score = F.col("ic") + 2.0 * F.greatest(F.col("dir_acc") - 0.5, F.lit(0.0))
    scored = (trials if max_starts is None else trials.filter(F.col(start) < max_starts)).withColumn("score", score)
    rank = F.struct(F.col("score"), -F.col(start))
    row = F.struct("ic", "dir_acc", "score", start)
    early = F.col(start) < min_starts
    best = scored.groupBy(*keys).agg(
        F.max_by(F.when(early, row), F.when(early, rank)).alias("__early"), F.max_by(row, rank).alias("__all")
    )
    done = (F.col("__early.ic") >= EXIT_IC) & (F.col("__early.dir_acc") >= EXIT_DA)
    best = best.withColumn("__best", F.when(done, F.col("__early")).otherwise(F.col("__all")))
    best = best.select(*keys, "__best.*", F.coalesce(done, F.lit(False)).alias("early_exit"))
    poor = ((F.col("ic") < ABANDON_IC) | (F.col("dir_acc") < ABANDON_DA)) & (F.col(fold) >= 1)
    best = best.withColumn("abandoned", poor)
    stop = best.filter("abandoned")
    best = best.join(stop.groupBy(*by).agg(F.min(fold).alias("__stop")), by, "left")
    return best.filter(F.col("__stop").isNull() | (F.col(fold) <= F.col("__stop"))).drop("__stop")
