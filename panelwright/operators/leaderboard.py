"""Candidate leaderboard."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .ranks import distributed_ranks

METRICS = ("annual_return_pct", "sharpe", "max_drawdown_pct", "win_rate_pct")


def leaderboard(candidates: DataFrame, metrics: Sequence[str] = METRICS, by: Sequence[str] = ("board",)) -> DataFrame:
    """Ranks by Sharpe, growth and drawdown; identical metrics are flagged as duplicates.

    A board may hold any number of candidates: ranks are taken by range exchange, and the duplicate count is an
    aggregation joined back by the metrics.  The parsed candidates are written once, because each rank reads
    them again.
    """
    by = list(by)
    rows = materialize(candidates, "candidates")
    same = rows.groupBy(*by, *metrics).agg(F.count(F.lit(1)).alias("n_same"))
    renamed = same.withColumnsRenamed({k: f"__{k}" for k in [*by, *metrics]})
    on = F.lit(True)
    for k in [*by, *metrics]:
        on = on & rows[k].eqNullSafe(renamed[f"__{k}"])
    ranks = {"sharpe": "rank_sharpe", "annual_return_pct": "rank_return", "max_drawdown_pct": "rank_drawdown"}
    out = distributed_ranks(rows, ranks, by)
    return out.join(renamed, on).drop(*[f"__{k}" for k in [*by, *metrics]]).withColumn("duplicate", F.col("n_same") > 1)
