"""The feature table (F0): a declarative list of features applied in stages.

A feature names its stage, because window functions do not nest: stage 1 reads the panel's own columns, a
later stage reads the columns of the stages before it.  Every stage is one ``withColumns`` over the same
partitioning and order.  Sliding statistics of a symbol (``_rolled``) follow the first stage in one pass over its rows,
and the stages after it are plain expressions, so the whole table is built on one shuffle by symbol.  Features whose
inputs are absent are left out, block by block.  All but the raw ones end as 252-row z-scores, taken together in one
pass.

Market-wide series (macro, positioning, holdings, interest) do not depend on the symbol: their features are
built and scored once on the trading calendar, one row per day, and broadcast to the panel by date.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import indicators as ind
from ..functions.dates import cyclic, season_flags
from ..functions.expr import EPS, TRADING_DAYS, dealt, r, ratio, safe_ln
from ..operators.order_stats import rank_so_far
from ..operators.panel import asof_join
from ..operators.rolling import rolled_columns, rolling_z_all
from ..session import materialize

Build = Callable[[Sequence[str]], Column]


@dataclass(frozen=True)
class Feature:
    name: str
    stage: int
    build: Build
    needs: tuple[str, ...] = ()
    score: bool = True
    keep: bool = True
    ranked: str | None = None
    rolled: tuple[str, int, tuple[str, ...]] | None = None


def _f(name, stage, build, *needs, score=True, keep=True) -> Feature:
    return Feature(name, stage, build, tuple(needs), score, keep)


def _step(name, stage, build, *needs) -> Feature:
    """A column other features read, not a feature itself."""
    return Feature(name, stage, build, tuple(needs), False, False)


def _rolled(name, kind, n, *needs, score=False, keep=False) -> Feature:
    """A statistic of a symbol's last rows (``operators.rolling``), taken after the expressions of the first stage."""
    return Feature(name, 1, lambda by: F.lit(None).cast("double"), tuple(needs), score, keep, rolled=(kind, n, tuple(needs)))


def _extreme(name, column) -> Feature:
    """Percentile of a column of the panel among its last 252 rows; counted, not built from an expression."""
    return Feature(name, 1, lambda by: F.lit(None).cast("double"), (column,), ranked=column)


# Return horizons, volatility windows, averages, lags.
RETURNS, VOLS, AVERAGES, ROCS, LAGS = (1, 3, 5, 10, 21), (10, 20, 60), (20, 50, 200), (5, 10, 20), (1, 2, 3, 5, 10)


def price_block() -> list[Feature]:
    """Features of a symbol's own closes."""
    out = [_step("_r1", 1, lambda by: ind.log_return("close", 1, by), "close")]
    out += [_step("_chg", 1, lambda by: ind.difference("close", 1, by), "close")]
    out += [_rolled(f"_ma{n}", "mean", n, "close") for n in (20, 50, 60, 200)]
    out += [_rolled(f"_std{n}", "std", n, "_r1") for n in VOLS]
    out += [_rolled("_gain14", "gain", 14, "_chg"), _rolled("_loss14", "loss", 14, "_chg"), _rolled("_low10", "min", 10, "close")]
    out += [_rolled("_ma50_was", "lag", 21, "_ma50"), _rolled("_std20_was", "lag", 5, "_std20")]
    out += [_f(f"r{p}", 1, lambda by, p=p: ind.log_return("close", p, by), "close") for p in RETURNS]
    out += [_f(f"roc{p}", 1, lambda by, p=p: ind.simple_return("close", p, by), "close") for p in ROCS]
    out += [_step(f"_vol{n}", 2, lambda by, n=n: F.col(f"_std{n}") * ind.ANNUAL, f"_std{n}") for n in VOLS]
    out += [_f(f"vol{n}", 3, lambda by, n=n: F.col(f"_vol{n}"), f"_vol{n}") for n in VOLS]
    out += [_f(f"ma{n}_dist", 2, lambda by, n=n: ratio("close", f"_ma{n}") - 1, f"_ma{n}") for n in AVERAGES]
    out += [_f("ma_cross", 2, lambda by: F.col("_ma50") / (F.col("_ma200") + EPS) - 1, "_ma50", "_ma200")]
    out += [_f("ma50_slope", 2, lambda by: ratio("_ma50", "_ma50_was") - 1, "_ma50", "_ma50_was")]
    out += [_f("rsi14", 2, lambda by: ind.strength("_gain14", "_loss14") / 100, "_gain14", "_loss14")]
    out += [_f("macd", 2, lambda by: F.col("macd_hist") / (F.col("close") + EPS), "macd_hist")]
    out += [_rolled(f"r1_lag{k}", "lag", k, "_r1", score=True, keep=True) for k in LAGS]
    out += [_f("vol_regime", 3, lambda by: F.col("_vol20") / (F.col("_vol60") + EPS), "_vol20", "_vol60")]
    out += [_f("vol_accel", 3, lambda by: F.col("_vol20") - F.col("_std20_was") * ind.ANNUAL, "_vol20", "_std20_was")]
    out += [_f("trend_strength", 2, lambda by: (F.col("_ma20") - F.col("_ma200")) / (F.col("_ma200") + EPS), "_ma20", "_ma200")]
    out += [_rolled("trend_align", "falling", 20, "_ma20", "_ma60", "_ma200", score=True, keep=True)]
    out += [_f("low_dist", 2, lambda by: (F.col("close") - F.col("_low10")) / (F.col("_low10") + EPS), "_low10")]
    return out


def momentum_block() -> list[Feature]:
    """Long horizons, acceleration, volatility-adjusted momentum and season flags of the technology variant."""
    out = [_f(f"r{p}", 1, lambda by, p=p: ind.log_return("close", p, by), "close") for p in (63, 126)]
    out += [_step("_r21", 1, lambda by: ind.log_return("close", 21, by), "close")]
    out += [_rolled("_r21_was", "lag", 5, "_r21")]
    out += [_f("r21_chg5", 2, lambda by: F.col("_r21") - F.col("_r21_was"), "_r21", "_r21_was")]
    out += [_f("vol_adj_r21", 3, lambda by: F.col("_r21") / (F.col("_vol20") + EPS), "_r21", "_vol20")]
    out += [_f(n, 1, lambda by, n=n: season_flags("date")[n], "date", score=False) for n in season_flags("date")]
    out += [_rolled("season_phase", "sum", 5, "in_season", score=True, keep=True)]
    return out


def season_block() -> list[Feature]:
    """Cyclic calendar encodings of the energy variant; raw, not scored."""
    return [_f(n, 1, lambda by, n=n: cyclic("date")[n], "date", score=False) for n in cyclic("date")]


def relation_block(other: str) -> list[Feature]:
    """The symbol against a reference series in column ``other``."""
    level = lambda: F.col("close") / (F.col(other) + EPS)
    spread = lambda by: ind.log_return("close", 5, by) - ind.log_return(other, 5, by)
    return [
        _f(f"{other}_ratio", 1, lambda by: level(), "close", other),
        _f(f"{other}_mom5", 1, lambda by: ind.log_return(level(), 5, by), "close", other),
        _f(f"{other}_mom21", 1, lambda by: ind.log_return(level(), 21, by), "close", other),
        _f(f"{other}_spread5", 1, spread, "close", other),
        _step(f"_{other}_r1", 1, lambda by: ind.log_return(other, 1, by), other),
        _rolled(f"{other}_corr10", "corr", 10, "_r1", f"_{other}_r1", score=True, keep=True),
        _rolled(f"_{other}_corr10_was", "lag", 5, f"{other}_corr10"),
        _f(f"{other}_corr_chg", 2, lambda by: F.col(f"{other}_corr10") - F.col(f"_{other}_corr10_was"), f"{other}_corr10", f"_{other}_corr10_was"),
        _rolled(f"{other}_corr20", "corr", 20, "_r1", f"_{other}_r1", score=True, keep=True),
    ]


def level_block(name: str, level: bool = True, changes: Iterable[int] = (), returns: Iterable[int] = (), spike: bool = False, accel: bool = False) -> list[Feature]:
    """A market-wide series: level, differences, log returns, spike and second difference."""
    out = [_f(f"{name}_level", 1, lambda by: F.col(name), name)] if level else []
    out += [_f(f"{name}_chg{n}", 1, lambda by, n=n: ind.difference(name, n, by), name) for n in changes]
    out += [_f(f"{name}_r{n}", 1, lambda by, n=n: ind.log_return(name, n, by), name) for n in returns]
    if spike:
        out += [_f(f"{name}_spike", 1, lambda by: ind.difference(name, 3, by) / (F.col(name) + EPS), name)]
    if accel:
        out += [_f(f"{name}_accel", 1, lambda by: ind.second_difference(name, 5, by), name)]
    return out


def term_structure_block(near: str, far: str) -> list[Feature]:
    curve = f"_{near}_curve"
    return [
        _step(curve, 1, lambda by: F.col(near) / (F.col(far) + EPS), near, far),
        _f(f"{near}_curve", 2, lambda by: F.col(curve), curve),
        _f(f"{near}_curve_chg5", 2, lambda by: ind.difference(curve, 5, by), curve),
        _f(f"{near}_inverted", 2, lambda by: ind.share_true(F.coalesce(F.col(curve) > 1.0, F.lit(False)), 5, by), curve),
    ]


def spread_block(a: str, b: str, scale: float = 1.0) -> list[Feature]:
    """Scaled difference of two series and the momentum of its clipped level."""
    name = f"_{a}_{b}_spread"
    clipped = lambda: F.greatest(F.col(name), F.lit(1.0))
    return [
        _step(name, 1, lambda by: F.col(a) * scale - F.col(b), a, b),
        _f(f"{a}_{b}_spread", 2, lambda by: F.col(name), name),
        _f(f"{a}_{b}_spread_r5", 2, lambda by: safe_ln(ratio(clipped(), ind.lagged(clipped(), 5, by))), name),
    ]


def reference_block(references: Sequence[str]) -> list[Feature]:
    """Returns and volatility of every reference series, level ratio and correlation of every pair."""
    out = []
    for c in references:
        out += [_step(f"_{c}_ret", 1, lambda by, c=c: ind.log_return(c, 1, by), c)]
        out += [_f(f"{c}_r{n}", 1, lambda by, c=c, n=n: ind.log_return(c, n, by), c) for n in (5, 21)]
        out += [_f(f"{c}_vol20", 2, lambda by, c=c: ind.rolling_vol(f"_{c}_ret", 20, by), f"_{c}_ret")]
    for a, b in combinations(references, 2):
        out += [_f(f"{a}_{b}_level", 1, lambda by, a=a, b=b: F.col(a) / (F.col(b) + EPS), a, b)]
        out += [_f(f"{a}_{b}_corr20", 2, lambda by, a=a, b=b: ind.rolling_corr(f"_{a}_ret", f"_{b}_ret", 20, by), f"_{a}_ret", f"_{b}_ret")]
    return out


def positions_block() -> list[Feature]:
    out = level_block("net_spec", changes=(4, 13)) + level_block("net_comm", changes=(4,)) + level_block("spec_oi_ratio", changes=(4,))
    out += [_extreme("net_spec_extreme", "net_spec")]
    out += [_f("spec_comm_gap", 1, lambda by: F.col("net_spec") - F.col("net_comm"), "net_spec", "net_comm")]
    return out


def holdings_block(name: str = "holdings") -> list[Feature]:
    out = level_block(name, changes=(5, 21), accel=True)
    out += [_step(f"_{name}_ma63", 1, lambda by: ind.rolling_mean(name, 63, by=by), name)]
    out += [_f(f"{name}_trend", 2, lambda by: (F.col(name) - F.col(f"_{name}_ma63")) / (F.col(f"_{name}_ma63") + EPS), f"_{name}_ma63")]
    out += [_extreme(f"{name}_pct", name)]
    return out


def interest_block(name: str = "attention") -> list[Feature]:
    return level_block(name, changes=(4,))


def chase_block(change: str = "attention_raw_chg4") -> list[Feature]:
    """Change of attention per unit of the symbol's own monthly move."""
    chase = lambda by: F.col(change) / (F.abs(ind.log_return("close", 21, by)) + 0.01)
    return [_f("attention_chase", 1, chase, change, "close")]


def divergences(macro: Sequence[str]) -> dict[str, tuple[str, str]]:
    """Score of the 5-row return less the score of a series' 5-row change, scored again."""
    return {f"{m}_divergence": ("r5", f"{m}_chg5") for m in macro}


@dataclass(frozen=True)
class Variant:
    """Feature lists of one family of instruments: per symbol, market-wide, and gaps between scored columns."""

    symbol: tuple[Feature, ...]
    market: tuple[Feature, ...]
    gaps: tuple[tuple[str, tuple[str, str]], ...] = ()
    references: tuple[str, ...] = ("anchor",)


REFERENCES = ("anchor", "second", "third")


def variant(kind: str, references: Sequence[str] = REFERENCES, macro: Sequence[str] = ("gpr",)) -> Variant:
    """The first reference is the anchor; curve and spread need a second and third one and are left out without."""
    symbol = [_rolled("macd_hist", "macd", 9, "close"), *price_block(), *chase_block()]
    for c in references:
        symbol += relation_block(c)
    market = interest_block() + reference_block(references)
    if len(references) > 2:
        market += term_structure_block(references[1], references[2]) + spread_block(references[0], references[1])
    for m in macro:
        market += level_block(m, changes=(5, 21))
    if kind == "metals":
        return Variant(tuple(symbol), tuple(market + positions_block() + holdings_block()), tuple(divergences(macro).items()), tuple(references))
    if kind == "technology":
        return Variant(tuple(symbol + momentum_block()), tuple(market), references=tuple(references))
    if kind == "energy":
        return Variant(tuple(symbol + season_block()), tuple(market + positions_block()), references=tuple(references))
    raise ValueError(f"unknown variant {kind!r}")


def usable(features: Sequence[Feature], columns: Iterable[str]) -> list[Feature]:
    """Features whose inputs exist, following dependencies stage by stage."""
    have, out = set(columns), []
    for f in sorted(features, key=lambda f: (f.stage, f.rolled is not None)):
        if set(f.needs) <= have:
            out.append(f)
            have.add(f.name)
    return out


def raw_features(df: DataFrame, features: Sequence[Feature], by: Sequence[str] = ("symbol",), partitions: int | None = None) -> tuple[DataFrame, list[Feature]]:
    """All stages; with sliding statistics the rows end in the order of key and date, in ``partitions`` tasks."""
    chosen = usable(features, df.columns)
    counted = {f.name: f.ranked for f in chosen if f.ranked}
    rolled = {f.name: f.rolled for f in chosen if f.rolled}
    df = rank_so_far(df, counted, TRADING_DAYS, TRADING_DAYS, by) if counted else df
    if rolled:
        df = dealt(df, partitions, by) if partitions else df.repartition(*by)
    for stage in sorted({f.stage for f in chosen}):
        df = df.withColumns({f.name: f.build(by) for f in chosen if f.stage == stage and not f.ranked and not f.rolled})
        if stage == 1 and rolled:
            df = rolled_columns(df, rolled, by)
    kept = [f for f in chosen if f.keep]
    return df, kept


def build_features(
    panel: DataFrame,
    features: Sequence[Feature],
    by: Sequence[str] = ("symbol",),
    date: str = "date",
    window: int = TRADING_DAYS,
    target_horizons: Sequence[int] = (17, 18, 19, 20),
    carry: Sequence[str] = (),
    gaps: Mapping[str, tuple[str, str]] | None = None,
    partitions: int | None = None,
    digits: int | None = None,
) -> tuple[DataFrame, list[str]]:
    """``symbol, date, features..., target`` and the feature names; incomplete rows are kept for the caller.

    Features that read the MACD histogram need ``indicators.macd`` to have added it to the panel.  ``carry``
    names columns to pass through.  ``partitions`` sets the tasks of the windows by key,
    ``digits`` rounds the features.
    """
    aim = _step("__target", 1, lambda by: ind.smoothed_target("close", target_horizons, by), "close")
    df, kept = raw_features(panel, [aim, *features], by, partitions)
    in_order = any(f.rolled for f in usable(features, panel.columns))
    names = [f.name for f in kept]
    df = df.select(*by, date, *carry, *names, F.col("__target").alias("target"))
    have = {f.name for f in kept if f.score} | set(carry)
    gaps = {g: pair for g, pair in (gaps or {}).items() if set(pair) <= have}
    scored = rolling_z_all(df, [f.name for f in kept if f.score], window, by=by, order=date, gaps=gaps, in_order=in_order, digits=digits)
    plain = {f.name: r(f.name, digits) for f in kept if not f.score} if digits is not None else {}
    scored = scored.withColumns(plain) if plain else scored
    return scored, [*names, *gaps]


def market_features(days: DataFrame, features: Sequence[Feature], date: str = "date", carry: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """Scored market-wide features, one row per trading day; the only group is the calendar itself."""
    board = ["__board"]
    df, kept = raw_features(days.withColumn("__board", F.lit(1)), features, board)
    names = [f.name for f in kept]
    df = df.select(*board, date, *carry, *names)
    return rolling_z_all(df, [f.name for f in kept if f.score], by=board, order=date).drop(*board), names


def attach_series(days: DataFrame, series: DataFrame, name: str, value: str = "value", lag_bdays: int = 0) -> DataFrame:
    """Adds a market-wide series as a column, as of each date, after its publication lag."""
    return asof_join(days, series.withColumnRenamed(value, name), [name], lag_bdays=lag_bdays)


def build_variant(panel: DataFrame, market_days: DataFrame, kind: Variant, partitions: int | None = None, digits: int | None = None) -> tuple[DataFrame, list[str]]:
    """The full table of a variant from a price panel and the market-wide series per trading day, rounded to ``digits``.

    The scored market table has the calendar's size and is written once.  Only the columns that symbol
    features read are broadcast to the panel before its windows; the rest follow after the scores, so they are
    not carried through sorts, windows and kernels.
    """
    days = market_days
    if "attention" in days.columns:
        keyed = days.withColumn("__b", F.lit(1))
        days = keyed.withColumn("attention_raw_chg4", ind.difference("attention", 4, ["__b"])).drop("__b")
    raw = [c for c in (*kind.references, "attention_raw_chg4") if c in days.columns]
    scored, market_names = market_features(days, kind.market, carry=raw)
    scored = materialize(scored, "market")
    early = [b for _, (_, b) in kind.gaps if b in market_names]
    late = [c for c in market_names if c not in early]
    joined = panel.join(scored.select("date", *raw, *early), "date", "left")
    df, names = build_features(joined, kind.symbol, carry=early, gaps=dict(kind.gaps), partitions=partitions, digits=digits)
    shown = lambda c: F.col(c) if digits is None else r(c, digits).alias(c)
    df = df.select(*[shown(c) if c in early else c for c in df.columns])
    # Rounded once per day, before the days meet the symbols.
    df = df.join(scored.select("date", *[shown(c) for c in late]), "date", "left")
    return df, [*names, *early, *late]
