"""Feature selection: redundancy by correlation, ranking by information coefficient."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import as_list, avg_rank, correlation, ordered, whole

# Correlation limit, share of history used for ranking, features kept, smallest |IC|.
CORR_LIMIT, RANK_SHARE, TOP_N, MIN_IC = 0.85, 0.7, 45, 0.02

# Columns of the moment table of a pair of features.
MOMENTS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def pair_moments(df: DataFrame, features: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Counts and sums of every feature pair over the rows that have both, per key: one row per key, pair and task.

    A task sorts its rows by key and holds the matrices of one key at a time: each batch adds a few matrix products of
    values and presence, and the sums are written when the key ends.  Features are shifted by ``df``'s means first, so
    the sums do not cancel.
    """
    features, by = list(features), as_list(by)
    means = df.agg(*[F.avg(F.col(f).cast("double")).alias(f"m{i}") for i, f in enumerate(features)]).first()
    centre = [m if m is not None and m == m and abs(m) != float("inf") else 0.0 for m in means]
    rows = df.select(*by, *[F.col(f).cast("double").alias(f"__{i}") for i, f in enumerate(features)])
    rows = rows.sortWithinPartitions(*by) if by else rows
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in by), "i int, j int", *(f"{m} double" for m in MOMENTS)])

    def run(frames):
        import numpy as np
        import pandas as pd

        k = len(features)
        i, j = np.triu_indices(k, 1)

        def products(own):
            x = own[[f"__{f}" for f in range(k)]].to_numpy(float) - centre
            has = (~np.isnan(x)).astype(float)
            x = np.nan_to_num(x, nan=0.0)
            return np.stack([has.T @ has, x.T @ has, has.T @ x, (x * x).T @ has, has.T @ (x * x), x.T @ x])

        def table(key, sums):
            cells = pd.DataFrame({"i": i, "j": j, **{m: v[i, j] for m, v in zip(MOMENTS, sums, strict=True)}})
            for name, value in zip(by, key, strict=True):
                cells[name] = pd.Series([None if pd.isna(value) else value] * len(cells), dtype=object)
            return cells[[*by, "i", "j", *MOMENTS]]

        held, sums = None, None
        for frame in frames:
            for key, own in frame.groupby(by, dropna=False, sort=False) if by else [((), frame)]:
                # Null keys come as values that do not equal themselves.
                if held is not None and all(a == b or (pd.isna(a) and pd.isna(b)) for a, b in zip(held, key, strict=True)):
                    sums += products(own)
                    continue
                if held is not None:
                    yield table(held, sums)
                held, sums = key, products(own)
        if held is not None:
            yield table(held, sums)

    return rows.mapInPandas(run, schema)


def feature_corr(df: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation of every pair ``i < j`` in list order (F1), as rows ``(i, j, fi, fj, rho)``, per key if wanted.

    Each pair uses the rows that have both features, whatever the number of features; NULL where one does not vary.
    """
    by, features = as_list(by), list(features)
    sums = pair_moments(df, features, by).groupBy(*by, "i", "j").agg(*[F.sum(m).alias(m) for m in MOMENTS])
    n = F.col("n")
    vx, vy = F.col("sxx") - F.col("sx") * F.col("sx") / n, F.col("syy") - F.col("sy") * F.col("sy") / n
    # Below the rounding error of the sums a feature does not vary.
    varies = (n > 1) & (vx > 1e-12 * F.col("sxx")) & (vy > 1e-12 * F.col("syy"))
    rho = F.when(varies, (F.col("sxy") - F.col("sx") * F.col("sy") / n) / F.sqrt(vx * vy))
    name = lambda k: F.element_at(F.array(*map(F.lit, features)), F.col(k) + 1)
    return sums.filter(n > 0).select(*by, "i", "j", name("i").alias("fi"), name("j").alias("fj"), rho.alias("rho"))


def redundant(corr: DataFrame, limit: float = CORR_LIMIT, by: Sequence[str] = ()) -> DataFrame:
    """Features to drop: any feature that correlates above the limit with an earlier one (F2)."""
    high = corr.filter((F.abs("rho") > limit) & ~F.isnan("rho"))
    return high.select(*as_list(by), F.col("fj").alias("feature")).distinct()


def drop_correlated(df: DataFrame, features: Sequence[str], limit: float = CORR_LIMIT) -> tuple[DataFrame, list[str]]:
    """The table without redundant features, and the names kept; the names (k at most) are read back."""
    gone = {row["feature"] for row in redundant(feature_corr(df, features), limit).collect()}
    return df.drop(*gone), [f for f in features if f not in gone]


def melt(df: DataFrame, features: Sequence[str], keys: Sequence[str]) -> DataFrame:
    return df.unpivot(as_list(keys), list(features), "feature", "value")


def rank_ic(
    df: DataFrame,
    features: Sequence[str],
    target: str = "target",
    share: float | None = RANK_SHARE,
    by: Sequence[str] = ("symbol",),
    date: str = "date",
) -> DataFrame:
    """|Spearman correlation| of each feature with the target on the first ``share`` of rows.

    Pairs with a NULL are left out and an undefined coefficient counts as 0.  Ranks are taken within
    (key, feature): a group is one symbol's history.
    """
    by = as_list(by)
    rows = df.select(*by, date, target, *features)
    if share is not None:
        w = ordered(by, date)
        rows = rows.withColumn("__rn", F.row_number().over(w)).withColumn("__n", F.count(F.lit(1)).over(whole(by)))
        rows = rows.filter(F.col("__rn") <= F.floor(F.col("__n") * share)).drop("__rn", "__n")
    keys = [*by, "feature"]
    long = melt(rows, features, [*by, date, target]).dropna("any", subset=["value", target])
    ranked = long.withColumns({"__rx": avg_rank(keys, "value"), "__ry": avg_rank(keys, target)})
    ic = correlation("__rx", "__ry")
    return ranked.groupBy(*keys).agg(
        F.when(ic.isNull() | F.isnan(ic), 0.0).otherwise(ic).alias("ic"), F.count(F.lit(1)).alias("n")
    ).withColumn("abs_ic", F.abs("ic"))


def importance(
    ics: DataFrame, top_n: int = TOP_N, min_ic: float = MIN_IC, by: Sequence[str] = ("symbol",), digits: int = 12
) -> DataFrame:
    """Rank by |IC|, flag the top ``top_n`` above the floor as selected.

    The rank uses |IC| rounded to ``digits`` so that equal coefficients tie by name on every run.
    """
    w = Window.partitionBy(*as_list(by)).orderBy(F.round("abs_ic", digits).desc(), "feature")
    ranked = ics.withColumn("rank", F.row_number().over(w))
    return ranked.withColumn("selected", (F.col("rank") <= top_n) & (F.col("abs_ic") >= min_ic))


def select_features(
    df: DataFrame,
    features: Sequence[str],
    target: str = "target",
    by: Sequence[str] = ("symbol",),
    limit: float = CORR_LIMIT,
    share: float = RANK_SHARE,
    top_n: int = TOP_N,
    min_ic: float = MIN_IC,
) -> DataFrame:
    """Redundancy filter, IC ranking and floor together: the importance table of the kept features."""
    _, kept = drop_correlated(df, features, limit)
    return importance(rank_ic(df, kept, target, share, by), top_n, min_ic, by)
