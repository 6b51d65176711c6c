"""Cleaning, filling and joining panels.

Deduplication is an aggregation (``max_by``), which combines map-side: a key that holds a third of the raw
rows is reduced before it is shuffled.  Only deduplicated panels, at most one row per key and day, enter
windows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import add_bdays
from ..functions.expr import as_list, dealt, finite, ordered, up_to_now


def keep_by_max(df: DataFrame, keys: Sequence[str], rank: Column | str | Sequence) -> DataFrame:
    """One whole row per key, the one with the largest rank."""
    keys = as_list(keys)
    rank = F.struct(*rank) if isinstance(rank, (list, tuple)) else rank
    rest = [c for c in df.columns if c not in keys]
    kept = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("__row"))
    return kept.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest]).select(*df.columns)


def normalize_dates(df: DataFrame, ts: str, by: Sequence[str] = ("symbol",), tiebreak: Sequence[str] = ()) -> DataFrame:
    """Timestamp to date, newest row per key and day."""
    rank = [F.col("__ts"), *[F.col(c) for c in tiebreak]]
    dated = df.withColumn("__ts", F.col(ts)).withColumn("date", F.to_date(ts))
    if ts != "date":
        dated = dated.drop(ts)
    return keep_by_max(dated, [*as_list(by), "date"], rank).drop("__ts")


def dedup_max(df: DataFrame, keys: Sequence[str], by: str) -> DataFrame:
    return keep_by_max(df, keys, by)


def latest(df: DataFrame, by: Sequence[str] = ("symbol",), date: str = "date") -> DataFrame:
    """The newest row per key (K3)."""
    return keep_by_max(df, by, date)


def text_match(c: str, contains: str | None = None, startswith: str | None = None) -> Column:
    """Upper-case containment or prefix of the trimmed text."""
    if contains is not None:
        return F.upper(F.col(c)).contains(contains.upper())
    return F.trim(F.col(c)).startswith(startswith)


def clean_inf(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """NaN and infinities to NULL in the given (default: all) double columns."""
    if columns is None:
        columns = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: finite(c) for c in columns})


def null_rates(df: DataFrame, columns: Sequence[str], floor: float | None = None, top: int | None = None) -> DataFrame:
    """Share of NULLs per column, largest first."""
    rates = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    long = rates.unpivot([], list(columns), "feature", "null_rate")
    if floor is not None:
        long = long.filter(F.col("null_rate") > floor)
    return long.orderBy(F.desc("null_rate"), "feature").limit(top) if top else long


def drop_sparse(df: DataFrame, columns: Sequence[str], limit: float = 0.05) -> DataFrame:
    """Drops columns whose NULL share exceeds the limit; one pass over the data."""
    row = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns]).first()
    return df.drop(*[c for c in columns if row[c] is not None and row[c] > limit])


def drop_all_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drops columns without a single value."""
    row = df.agg(*[F.count(c).alias(c) for c in columns]).first()
    return df.drop(*[c for c in columns if row[c] == 0])


def complete_cases(df: DataFrame, columns: Sequence[str], target: str | None = None) -> DataFrame:
    """Rows on which all the columns and the target are filled."""
    return df.dropna("any", subset=[*columns, *([target] if target else [])])


def align_schema(df: DataFrame, names: Sequence[str], keys: Sequence[str] = (), fill: float = 0.0) -> DataFrame:
    """Exactly the named double columns in the named order, NULL or absent ones filled."""
    have = set(df.columns)
    values = [
        (F.coalesce(finite(F.col(n).cast("double")), F.lit(fill)) if n in have else F.lit(fill)).alias(n)
        for n in names
    ]
    return df.select(*keys, *values)


def ffill(
    df: DataFrame,
    columns: Sequence[str],
    by: Sequence[str] = ("symbol",),
    order: str = "date",
    max_age_days: int | None = None,
) -> DataFrame:
    """Last value seen, optionally only while it is at most ``max_age_days`` old."""
    w = up_to_now(by, order)
    if max_age_days is None:
        return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})
    seen = {
        f"__{c}": F.last(F.when(F.col(c).isNotNull(), F.struct(F.col(order).alias("d"), F.col(c).alias("v"))), True).over(w)
        for c in columns
    }
    aged = {
        c: F.when(F.datediff(F.col(order), F.col(f"__{c}.d")) <= max_age_days, F.col(f"__{c}.v")) for c in columns
    }
    return df.withColumns(seen).withColumns(aged).drop(*seen)


def bfill(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ("symbol",), order: str = "date") -> DataFrame:
    """Next value seen.  It reads the future: opt-in only.

    Written as a forward fill over the reversed order; Spark recomputes a frame that ends at the partition's
    end for every row.
    """
    w = ordered(by, F.col(order).desc()).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def asof_join(
    left: DataFrame,
    right: DataFrame,
    values: Sequence[str],
    by: Sequence[str] = (),
    date: str = "date",
    lag_bdays: int = 0,
    max_age_days: int | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Last right-hand row at or before each left date, after a publication lag.

    The lookup is resolved once per distinct (key, day) of the left side, in a window whose group is bounded
    by the number of days, and joined back by equality.  However many left rows share a key, none of them
    passes through the window.  ``partitions`` sets the tasks of that window.
    """
    by, values = as_list(by), list(values)
    published = right.withColumn("__obs", F.col(date))
    if lag_bdays:
        published = published.withColumn(date, add_bdays(date, lag_bdays))
    payload = F.struct(F.col("__obs"), *[F.col(v) for v in values])
    published = published.groupBy(*by, date).agg(F.max(payload).alias("__hit"))  # the newest; of several, the largest values
    asked = left.select(*by, date).distinct().withColumn("__asked", F.lit(True))
    both = dealt(published.withColumn("__asked", F.lit(False)).unionByName(asked, allowMissingColumns=True), partitions, by)
    w = ordered(by, date, "__asked").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__hit", F.last("__hit", ignorenulls=True).over(w)).filter("__asked")
    if max_age_days is not None:
        fresh = F.datediff(F.col(date), F.col("__hit.__obs")) <= max_age_days
        found = found.withColumn("__hit", F.when(fresh, F.col("__hit")))
    found = found.select(*by, date, *[F.col(f"__hit.{v}").alias(v) for v in values])
    return left.join(found, [*by, date], "left")


def nearest_join(
    left: DataFrame,
    right: DataFrame,
    values: Sequence[str],
    by: Sequence[str] = (),
    date: str = "date",
    tol_days: int = 3,
) -> DataFrame:
    """Right-hand row closest in time within a tolerance, the earlier one on a tie.

    Right rows are offered to the few days around them and reduced to the best per (key, day); the join is
    then an equality, never a range comparison of all pairs.
    """
    by, values = as_list(by), list(values)
    offset = F.explode(F.sequence(F.lit(-tol_days), F.lit(tol_days)))
    offered = right.select(*by, F.col(date).alias("__obs"), *values, offset.alias("__off"))
    offered = offered.withColumn(date, F.date_add("__obs", F.col("__off")))
    best = offered.groupBy(*by, date).agg(F.min(F.struct(F.abs("__off").alias("__far"), "__obs", *values)).alias("__hit"))
    picked = best.select(
        *by, date, F.col("__hit.__obs").alias("matched_date"), *[F.col(f"__hit.{v}").alias(v) for v in values]
    )
    return left.join(picked, [*by, date], "left")


def align_pair(a: DataFrame, b: DataFrame, on: Sequence[str] = ("date",)) -> DataFrame:
    """Rows present on both sides with every column filled."""
    return a.join(b, as_list(on), "inner").dropna("any")


def mark_members(df: DataFrame, members: DataFrame, on: Sequence[str], name: str = "is_oof") -> DataFrame:
    """Boolean flag for rows whose key is in another table."""
    on = as_list(on)
    keys = members.select(*on).distinct().withColumn("__member", F.lit(True))
    return df.join(keys, on, "left").withColumn(name, F.coalesce("__member", F.lit(False))).drop("__member")


def non_members(df: DataFrame, members: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is not in another table."""
    return df.join(members.select(*as_list(on)), as_list(on), "left_anti")


def overlay(full: DataFrame, oof: DataFrame, on: Sequence[str], value: str = "pred") -> DataFrame:
    """Out-of-fold value where there is one (the largest of several), the model's fill elsewhere."""
    on = as_list(on)
    over = oof.groupBy(*on).agg(F.max(value).alias("__oof"))
    return full.join(over, on, "left").withColumn(value, F.coalesce("__oof", value)).drop("__oof")


def lookup0(df: DataFrame, table: DataFrame, on: Sequence[str], value: str) -> DataFrame:
    """Left lookup with 0 for a miss; the largest of several values."""
    on = as_list(on)
    return df.join(table.groupBy(*on).agg(F.max(value).alias(value)), on, "left").withColumn(value, F.coalesce(F.col(value), F.lit(0.0)))


def union_dates(a: DataFrame, b: DataFrame, date: str = "date") -> DataFrame:
    """Dates of either table from the later of the two first dates on."""
    start = F.greatest(a.agg(F.min(date)).scalar(), b.agg(F.min(date)).scalar())
    return a.select(date).unionByName(b.select(date)).filter(F.col(date) >= start).distinct()


def common_window(df: DataFrame, by: Sequence[str], date: str = "date") -> DataFrame:
    """The span covered by every key: latest start and earliest end."""
    spans = df.groupBy(*as_list(by)).agg(F.min(date).alias("lo"), F.max(date).alias("hi"))
    return spans.agg(F.max("lo").alias("window_start"), F.min("hi").alias("window_end"))


def without_overlap(intervals: DataFrame, blocks: DataFrame, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Intervals [start, end] that touch no block of the same key.

    Both sides are spread over their days, so the test is an equality join whose size is the covered days.
    """
    by = as_list(by)
    day = F.explode(F.sequence("start", "end", F.expr("interval 1 day"))).alias("__day")
    covered = blocks.select(*by, day).distinct()
    touched = intervals.select(*by, "start", "end", day).join(covered, [*by, "__day"], "left_semi")
    return intervals.join(touched.select(*by, "start", "end").distinct(), [*by, "start", "end"], "left_anti")
