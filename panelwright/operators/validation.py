"""Out-of-fold validation: blocks, non-overlapping trades, bootstrap and permutation tests."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import bday_index
from ..functions.expr import as_list, correlation, ordered, up_to_now
from ..session import materialize
from .chunks import draws, key_rows, places, scores

BY = ("strategy", "symbol")
METRICS = ("ic", "win_rate", "pct_return")

# Blocks and chunks a key needs for the test.
MIN_SAMPLES = (3, 30)

#: Standard deviations by which the rows that are sorted in a permutation outnumber, on average, those that are taken.
SPARE = 4

#: Differences below this are rounding of sums in another order, so ties stay ties.
SAME = 1e-9

#: Longest history of a key, some 250 years; a longer one is an error, not a cut.
MAX_BDAYS = 1 << 16


def blocks(df: DataFrame, gap: int = 30, by: Sequence[str] = BY, date: str = "date") -> DataFrame:
    """Numbers runs of rows; a gap of more than ``gap`` days starts a new one (V1)."""
    opens = F.datediff(F.col(date), F.lag(date).over(ordered(by, date))) > gap
    return df.withColumn("block", F.sum(F.coalesce(opens, F.lit(False)).cast("int")).over(up_to_now(by, date)))


def block_table(df: DataFrame, gap: int = 30, by: Sequence[str] = BY, date: str = "date") -> DataFrame:
    return blocks(df, gap, by, date).groupBy(*as_list(by), "block").agg(
        F.min(date).alias("start"), F.max(date).alias("end"), F.count(F.lit(1)).alias("n")
    )


def non_overlapping(
    df: DataFrame, hold: int = 20, min_signal: float = 0.008, mode: str = "cash_long", by: Sequence[str] = BY, date="date"
) -> DataFrame:
    """Trades entered only when the previous one has run ``hold`` business days (V2).

    Which day is next free depends on every earlier choice.  One sorted pass gives each qualifying day its successor, the
    next day that is free if it is entered; then pointer doubling marks what the first day reaches: with the jumps over
    1, 2, 4, ... successors in turn, the marked days and where they jump to, so that n trades take log n steps.  A key's
    successors are an array in one row, bounded by its days.
    """
    by = as_list(by)
    enters = F.abs("pred") >= min_signal
    if mode in ("cash_long", "long_only"):
        enters = enters & (F.col("pred") > 0)
    side = F.when(F.col("pred") > 0, 1.0).otherwise(-1.0)
    picked = df.filter(enters).withColumns({"bday_idx": bday_index(date), "side": side, "trade_ret": side * F.col("actual")})
    return picked if hold < 1 else reached(successors(picked, hold, by, date), "__next", hold, by).drop("__at", "__next")


def successors(df: DataFrame, hold: int, by: Sequence[str], date: str = "date") -> DataFrame:
    """Adds ``__at``, the row's place in its key by date from 0, and ``__next``, that of the first row that is free after it.

    An entry on a weekend frees up on the business day ``hold`` after the Friday before it; a weekend day is free from the
    Saturday after that day on.  Backwards in time the rows after a day are a frame that only grows, so both passes read
    each row once.
    """
    weekend = (F.weekday(date) >= 5).cast("int")
    placed = df.withColumns({"__at": F.row_number().over(ordered(by, date)) - 1, "__weekend": weekend, "__half": F.col("bday_idx") * 2 + weekend})
    back = Window.partitionBy(*by).orderBy(F.col("__half").desc())
    free = {w: F.min("__at").over(back.rangeBetween(Window.unboundedPreceding, w - 2 * hold)) for w in (0, 1)}
    return placed.withColumn("__next", F.when(F.col("__weekend") == 0, free[0]).otherwise(free[1])).drop("__weekend", "__half")


def reached(df: DataFrame, successor: str, hold: int, by: Sequence[str]) -> DataFrame:
    """The rows that the key's first row reaches by way of ``successor``, a later place (``__at``) in the key or null."""
    by = as_list(by)
    names = ["__at", *[c for c in df.columns if c not in (*by, "__at")]]
    rows = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*names))).alias("__rows"))
    steps = F.sequence(F.lit(1), F.lit((MAX_BDAYS // hold + 1).bit_length()))
    start = F.struct(F.array(F.lit(0)).alias("path"), F.col(f"__rows.{successor}").alias("jump"))

    def step(state: Column, _: Column) -> Column:
        jump = state["jump"]
        return F.struct(
            F.concat(state["path"], F.array_compact(F.transform(state["path"], lambda p: F.get(jump, p)))).alias("path"),
            F.transform(jump, lambda p: F.get(jump, p)).alias("jump"),
        )

    def whole(state: Column) -> Column:
        # A jump that is left would lead to trades beyond the last step's reach.
        longer = F.raise_error(F.lit(f"a key of more than {MAX_BDAYS} business days"))
        return F.when(F.get(state["jump"], F.lit(0)).isNull(), state["path"]).otherwise(longer.cast("array<int>"))

    path = F.aggregate(steps, start, step, whole)
    taken = rows.select(*by, F.explode(F.transform(path, lambda p: F.get("__rows", p))).alias("__row"))
    return taken.select(*[F.col(c) if c in by else F.col(f"__row.{c}").alias(c) for c in df.columns])


def oof_validation(
    preds: DataFrame, hold: int = 20, min_signal: float = 0.008, mode: str = "cash_long", by: Sequence[str] = BY,
    capital: float = 100_000.0, date: str = "date",
) -> DataFrame:
    """Metrics of the non-overlapping trades on out-of-fold days (V3); groups with fewer than two are left out."""
    by = as_list(by)
    oof = preds.filter("is_oof")
    base = oof.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_predictions"), F.min(date).alias("__lo"), F.max(date).alias("__hi"),
        correlation("pred", "actual").alias("ic"),
    ).filter("n_predictions >= 5")
    taken = non_overlapping(oof, hold, min_signal, mode, by, date)
    taken = taken.withColumn("__eq", F.sum("trade_ret").over(up_to_now(by, date)))
    taken = taken.withColumn("__dd", F.exp(F.col("__eq") - F.greatest(F.max("__eq").over(up_to_now(by, date)), F.lit(0.0))) - 1)
    sums = taken.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_trades"), F.sum("trade_ret").alias("__log"), F.avg("trade_ret").alias("__mean"),
        F.stddev_pop("trade_ret").alias("__std"), F.min("__dd").alias("__dd"),
        F.avg((F.col("trade_ret") > 0).cast("double")).alias("win_rate"),
    ).filter("n_trades >= 2")
    out = base.join(sums, by)
    days = F.datediff("__hi", "__lo")
    years = F.greatest(days / F.lit(365.25), F.lit(0.01))
    per_year = F.col("n_trades") / years
    open_days = F.greatest(days * 252 / F.lit(365.25), F.lit(1.0))
    out = out.withColumns(
        {
            "ic": F.coalesce("ic", F.lit(0.0)),
            "total_return_pct": (F.exp("__log") - 1) * 100,
            "annual_return_pct": (F.exp(F.col("__log") / years) - 1) * 100,
            "sharpe": F.when(F.col("__std") > 0, F.col("__mean") / F.col("__std") * F.sqrt(F.greatest(per_year, F.lit(1.0)))).otherwise(0.0),
            "max_drawdown_pct": F.least(F.col("__dd"), F.lit(0.0)) * 100,
            "trades_per_year": per_year,
            "final_capital": F.exp("__log") * capital,
            "time_in_market_pct": F.least(F.col("n_trades") * hold / open_days, F.lit(1.0)) * 100,
        }
    )
    return out.drop("__lo", "__hi", "__log", "__mean", "__std", "__dd")


def bootstrap(
    preds: DataFrame, n_boot: int = 300, seed: int = 42, hold: int = 20, min_signal: float = 0.008,
    gap: int = 30, by: Sequence[str] = BY, date: str = "date",
) -> DataFrame:
    """Metrics of every out-of-fold block (``is_oof``) and of ``n_boot`` random chunks per key (V4).

    Each key has exactly ``n_boot`` scored chunks, or a ``shortfall``: a key none of whose places scores is one row without
    a chunk.  Keys too short for chunks have their blocks only.  Keys are dealt once; what follows takes each by itself.
    """
    by = as_list(by)
    clean = materialize(places(key_rows(preds, by, date), by, gap, hold, min_signal), "clean-places")
    drawn = materialize(draws(clean, by, n_boot, seed), "draws")
    return materialize(scores(drawn, by, n_boot, gap, hold, min_signal), "scored-places")


def perm_test(samples: DataFrame, n_perm: int = 1000, seed: int = 42, by: Sequence[str] = BY, metrics=METRICS) -> DataFrame:
    """Permutation p-value of the mean difference, percentile and verdict per group (V5).

    A permutation is an order of the group's rows by a hash of the row, the permutation and the seed; its first ``n_oof``
    rows stand for the blocks, so only they are summed: the rest is what the total leaves.  One MD5 serves four
    permutations, eight digits each.  Only rows whose digits lie below a limit are sorted, some more than ``n_oof`` by
    chance; where they are fewer, all are.  A group is a few hundred rows by construction, one per block or chunk; groups
    are dealt once, and their permutations are exploded and counted where they lie.
    """
    by = as_list(by)
    rows = samples.filter("chunk IS NOT NULL")
    first = F.struct((~F.col("is_oof")).alias("later"), "chunk", *metrics)
    tasks = int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = rows.select(*by, "is_oof", "chunk", *metrics).repartition(tasks, *by).groupBy(*by).agg(
        F.count_if("is_oof").alias("n_oof"), F.count_if(~F.col("is_oof")).alias("n_boot"), F.array_sort(F.collect_list(first)).alias("__rows")
    ).filter((F.col("n_oof") >= MIN_SAMPLES[0]) & (F.col("n_boot") >= MIN_SAMPLES[1]))
    # Summed in the rows' order, so that no digit depends on the tasks.
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda t, v: t + v)
    for m in metrics:
        groups = groups.withColumn(f"__{m}", F.col(f"__rows.{m}"))
        own, rest = F.slice(f"__{m}", F.lit(1), F.col("n_oof").cast("int")), F.slice(f"__{m}", (F.col("n_oof") + 1).cast("int"), F.col("n_boot").cast("int"))
        groups = groups.withColumns({f"{m}_oof_mean": total(own) / F.col("n_oof"), f"{m}_nonoof_mean": total(rest) / F.col("n_boot"), f"__{m}_sum": total(f"__{m}")})
        below = F.size(F.filter(rest, lambda v: v < F.col(f"{m}_oof_mean") - SAME))  # noqa: B023
        groups = groups.withColumn(f"{m}_oof_pctile", below / F.col("n_boot") * 100)

    # Texts as bytes, which are cut and compared without a look at their characters.
    raw = lambda c: c.cast("binary")
    fours, n = (n_perm + 3) // 4, F.col("n_oof") + F.col("n_boot")
    share = F.least((F.col("n_oof") + SPARE * (F.sqrt("n_oof") + 1)) / n, F.lit(1.0))
    limit = F.lpad(F.lower(F.hex((share * ((1 << 32) - 1)).cast("long"))), 8, "0")
    places = F.sequence(F.lit(0), (n - 1).cast("int"))
    named = groups.drop("__rows").withColumns(
        {
            "__limit": raw(limit), "__names": F.transform(places, lambda i: raw(F.lpad(i.cast("string"), 9, "0"))),
            "__heads": F.transform(places, lambda i: raw(F.concat_ws("|", *by, i.cast("string"), F.lit("")))),
        }
    )
    # Exploded rather than projected: a projection would be folded into each of its uses and sort anew for every metric.
    tail = lambda b: raw(F.concat_ws("|", b.cast("string"), F.lit(str(seed))))
    several = named.withColumn("__four", F.explode(F.transform(F.sequence(F.lit(0), F.lit(fours - 1)), lambda b: F.struct(b.alias("at"), tail(b).alias("tail")))))
    several = several.withColumn("__hashes", F.zip_with("__heads", "__names", lambda head, i: F.concat(raw(F.md5(F.concat(head, F.col("__four.tail")))), i)))

    def chosen(at: Column) -> Column:
        digits = lambda h: F.substr(h, at, F.lit(8))
        few = F.filter("__hashes", lambda h: digits(h) <= F.col("__limit"))
        order = lambda rows: F.sort_array(F.transform(rows, lambda h: F.concat(digits(h), F.substr(h, F.lit(33)))))
        first = lambda rows: F.slice(order(rows), F.lit(1), F.col("n_oof").cast("int"))
        enough = F.transform(F.array(few), lambda rows: first(F.when(F.size(rows) >= F.col("n_oof"), rows).otherwise(F.col("__hashes"))))
        return F.transform(F.get(enough, F.lit(0)), lambda s: F.substr(s, F.lit(9)).cast("string").cast("int"))

    last = F.least(F.lit(3), F.lit(n_perm - 1) - F.col("__four.at") * 4)
    each = several.withColumn("__chosen", F.explode(F.transform(F.sequence(F.lit(1), last * 8 + 1, F.lit(8)), chosen)))

    def as_far(m: str) -> Column:
        picked = F.aggregate("__chosen", F.lit(0.0), lambda total, i: total + F.get(f"__{m}", i))
        apart = picked / F.col("n_oof") - (F.col(f"__{m}_sum") - picked) / F.col("n_boot")
        return F.abs(apart) >= F.abs(F.col(f"{m}_oof_mean") - F.col(f"{m}_nonoof_mean")) - SAME

    kept = ["n_oof", "n_boot", *(f"{m}_{c}" for m in metrics for c in ("oof_mean", "nonoof_mean", "oof_pctile"))]
    out = each.groupBy(*by).agg(*[F.first(c).alias(c) for c in kept], *[(F.count_if(as_far(m)) / F.lit(float(n_perm))).alias(f"{m}_perm_p") for m in metrics])
    flags = reduce(Column.__add__, [(F.col(f"{m}_perm_p") < 0.05).cast("long") for m in metrics])
    verdict = F.when(F.col("n_sig_flags") == 0, "GENERALIZES").when(F.col("n_sig_flags") == 1, "MARGINAL").otherwise("OVERFIT")
    names = [f"{m}_{c}" for m in metrics for c in ("oof_mean", "nonoof_mean", "oof_pctile", "perm_p")]
    return out.withColumn("n_sig_flags", flags).withColumn("verdict", verdict).select(*by, "n_oof", "n_boot", *names, "n_sig_flags", "verdict")


def sharpe_ratio_check(oof: DataFrame, full: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Out-of-fold Sharpe over full-history Sharpe (V6)."""
    by = as_list(by)
    a = oof.select(*by, F.col("sharpe").alias("oof_sharpe"))
    b = full.select(*by, F.col("sharpe").alias("full_sharpe"))
    return a.join(b, by).withColumn("sharpe_ratio", F.try_divide("oof_sharpe", "full_sharpe"))
