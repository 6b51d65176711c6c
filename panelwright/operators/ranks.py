"""Places, totals and ranks in a total order over groups of unbounded size, by range exchange.

Rows are dealt to range partitions, sorted there and written; a row's place is its place in its partition plus the rows
of the partitions before.  No key's rows meet in one task, and the plan is the same at any number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.expr import as_list
from ..session import materialize

#: ``monotonically_increasing_id`` keeps the place in the partition in so many low bits.
PLACE_BITS = 33



def _earlier_parts() -> WindowSpec:
    """Over one row per range partition; the only window here without a key."""
    return Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)


def _dealt(df: DataFrame, order: Sequence[Column], partitions: int | None, name: str) -> DataFrame:
    """``df`` with ``__part`` and ``__at``: its range partition and its place there, in order."""
    partitions = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(partitions, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    placed = materialize(dealt, name)
    return placed.withColumns({"__part": F.shiftright("__id", PLACE_BITS), "__at": F.col("__id").bitwiseAND((1 << PLACE_BITS) - 1)}).drop("__id")


def positions(df: DataFrame, order: Sequence[Column], name: str = "position", partitions: int | None = None) -> DataFrame:
    """Adds the row's place from 0 in the order of ``order``, which should tell all rows apart.

    Rows that ``order`` leaves tied get places of their own in any order, and share a range partition.
    """
    placed = _dealt(df, order, partitions, "positions")
    counts = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__ahead"))
    ahead = counts.select("__part", F.coalesce(F.sum("__ahead").over(_earlier_parts()), F.lit(0)).alias("__ahead"))
    return placed.join(ahead, "__part").select(*df.columns, (F.col("__ahead") + F.col("__at")).alias(name))


def totals_before(
    df: DataFrame, order: Sequence[Column], totals: Mapping[str, str], how: Callable = F.sum, partitions: int | None = None
) -> DataFrame:
    """Adds ``{new: column}``: the total of a long column over all rows that come earlier in ``order``; 0 for the first.

    ``how`` is ``sum`` or ``bit_xor``.
    """
    placed = _dealt(df, order, partitions, "totals")
    add = Column.bitwiseXOR if how is F.bit_xor else Column.__add__
    earlier = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    within = placed.withColumns({new: F.coalesce(how(c).over(earlier), F.lit(0)) for new, c in totals.items()})
    parts = placed.groupBy("__part").agg(*[how(c).alias(f"__{new}") for new, c in totals.items()])
    ahead = parts.select("__part", *[F.coalesce(how(f"__{new}").over(_earlier_parts()), F.lit(0)).alias(f"__{new}") for new in totals])
    both = within.join(ahead, "__part").withColumns({new: add(F.col(new), F.col(f"__{new}")) for new in totals})
    return both.drop("__part", "__at", *[f"__{new}" for new in totals])


def distributed_ranks(
    df: DataFrame, columns: Mapping[str, str], by: Sequence[str] = (), descending: bool = True, partitions: int | None = None
) -> DataFrame:
    """``rank()`` of columns, ``{value: new name}``, without gathering a key's rows in one task.

    Values are counted first, so that ties, however many, become one row map-side.  A value's rank is one more than the
    rows of its key with an earlier value: the counts before it over all keys, less those before its key.  NULLs rank
    last.  The input is read once per column.
    """
    by = as_list(by)
    out = df
    for value, name in columns.items():
        table = _rank_table(df, value, name, by, descending, partitions)
        on = df[value].eqNullSafe(table["__v"])
        for b in by:
            on = on & df[b].eqNullSafe(table[f"__k_{b}"])
        out = out.join(table, on).drop("__v", *[f"__k_{b}" for b in by])
    return out


def _rank_table(df, value, name, by, descending, partitions) -> DataFrame:
    keys = [F.col(b).alias(f"__k_{b}") for b in by]
    counted = df.groupBy(*keys, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    groups = [f"__k_{b}" for b in by]
    last = F.col("__v").desc_nulls_last() if descending else F.col("__v").asc_nulls_last()
    ranked = totals_before(counted, [*[F.col(g).asc() for g in groups], last], {"__ahead": "__n"}, partitions=partitions)
    if not groups:
        return ranked.select("__v", (F.col("__ahead") + 1).alias(name))
    starts = ranked.groupBy(*[F.col(g).alias(f"{g}_") for g in groups]).agg(F.min("__ahead").alias("__start"))
    on = F.lit(True)
    for g in groups:
        on = on & F.col(g).eqNullSafe(F.col(f"{g}_"))
    return ranked.join(starts, on).select(*groups, "__v", (F.col("__ahead") - F.col("__start") + 1).alias(name))
