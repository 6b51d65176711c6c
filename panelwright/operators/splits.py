"""Walk-forward splits, hold-outs and look-back sequences."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import as_list, ordered, whole


@dataclass(frozen=True)
class WalkForward:
    """Split settings in rows (M1)."""

    n_folds: int = 8
    val_months: int = 3
    purge: int = 40
    min_train_years: float = 2.0

    @property
    def val_size(self) -> int:
        return self.val_months * 21

    @property
    def min_train(self) -> int:
        return int(self.min_train_years * 252)


def _bounds(n, fold, cfg: WalkForward):
    """Validation start of a fold: evenly spaced from the first to the last possible start, truncated."""
    first = F.lit(float(cfg.min_train + cfg.purge))
    last = n.cast("double") - cfg.val_size
    step = (last - first) / float(max(cfg.n_folds - 1, 1))
    start = F.when(fold == cfg.n_folds - 1, last if cfg.n_folds > 1 else first).otherwise(first + fold * step)
    val_start = start.cast("bigint")
    return val_start - cfg.purge, val_start, F.least(val_start + cfg.val_size, n.cast("bigint"))


def wf_splits(df: DataFrame, cfg: WalkForward = WalkForward(), by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Purged expanding splits per key: ``fold, train_end, val_start, val_end`` (M1).

    Folds whose training part is too short, and keys too short for any, yield no row.
    """
    n = df.groupBy(*as_list(by)).agg(F.count(F.lit(1)).alias("n"))
    folds = n.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(cfg.n_folds - 1))))
    train_end, val_start, val_end = _bounds(F.col("n"), F.col("fold"), cfg)
    folds = folds.withColumns({"train_end": train_end, "val_start": val_start, "val_end": val_end})
    return folds.filter((F.col("train_end") >= cfg.min_train) & (F.col("val_start") < F.col("n")))


def assign_folds(
    df: DataFrame,
    cfg: WalkForward = WalkForward(),
    by: Sequence[str] = ("symbol",),
    date: str = "date",
    exclude_before: str | None = None,
) -> DataFrame:
    """Rows with every fold they train or validate (J13); ``exclude_before`` clips training rows only (M2).

    A fold's bounds follow from the key's row count, so the memberships are computed on the row itself.
    """
    by = as_list(by)
    rows = df.withColumn("row_idx", (F.row_number().over(ordered(by, date)) - 1).cast("bigint"))
    rows = rows.withColumn("__n", F.count(F.lit(1)).over(whole(by)))
    rows = rows.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(cfg.n_folds - 1))))
    train_end, val_start, val_end = _bounds(F.col("__n"), F.col("fold"), cfg)
    i = F.col("row_idx")
    role = F.when(i < train_end, "train").when((i >= val_start) & (i < val_end), "val")
    rows = rows.withColumn("role", F.when(train_end >= cfg.min_train, role)).filter(F.col("role").isNotNull()).drop("__n")
    if exclude_before is not None:
        rows = exclude_train_before(rows, exclude_before, date)
    return rows


def exclude_train_before(rows: DataFrame, cutoff: str, date: str = "date") -> DataFrame:
    return rows.filter((F.col("role") != "train") | (F.col(date) >= F.to_date(F.lit(cutoff))))


def holdout(df: DataFrame, share: float = 0.85, by: Sequence[str] = ("symbol",), date: str = "date") -> DataFrame:
    """Chronological train/test flag (M6)."""
    by = as_list(by)
    cut = F.floor(F.count(F.lit(1)).over(whole(by)) * share)
    return df.withColumn("part", F.when(F.row_number().over(ordered(by, date)) <= cut, "train").otherwise("test"))


def sequences(
    df: DataFrame,
    features: Sequence[str],
    lookback: int = 30,
    include_current: bool = False,
    by: Sequence[str] = ("symbol",),
    date: str = "date",
) -> DataFrame:
    """Adds ``sequence``: the feature rows of the look-back, oldest first; shorter ones are dropped (M3)."""
    w = ordered(by, date)
    w = w.rowsBetween(-(lookback - 1), 0) if include_current else w.rowsBetween(-lookback, -1)
    row = F.array(*[F.col(f).cast("float") for f in features])
    return df.withColumn("sequence", F.collect_list(row).over(w)).filter(F.size("sequence") == lookback)
