"""Arrow kernels over ordered groups, for recursions that window functions cannot express.

Spark partitions, shuffles and sorts; a kernel sees one bounded group (a symbol's days) as an Arrow table in
order and returns new columns.  Keys, dates and other columns stay in Arrow and are never turned into Python
objects.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .expr import as_list

ARROW = {"double": pa.float64(), "boolean": pa.bool_()}
Kernel = Callable[[pa.Table], Mapping[str, object]]
RunKernel = Callable[[pa.Table, np.ndarray], Mapping[str, object]]


def with_group_columns(
    df: DataFrame, by: Sequence[str], order: str | Sequence[str], new: Mapping[str, str], kernel: Kernel
) -> DataFrame:
    """Adds or replaces the columns ``{name: type}`` computed by the kernel on each ordered group."""
    fields = {f.name: f for f in df.schema.fields}
    for name, kind in new.items():
        fields[name] = T.StructType.fromDDL(f"`{name}` {kind}").fields[0]
    names, sort = list(fields), [(c, "ascending") for c in as_list(order)]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(sort)
        computed = {n: pa.array(v, ARROW[new[n]], from_pandas=True) for n, v in kernel(table).items()}
        return pa.table({n: computed[n] if n in computed else table.column(n) for n in names})

    return df.groupBy(*as_list(by)).applyInArrow(run, T.StructType(list(fields.values())))


def arranged(df: DataFrame, by: Sequence[str], order: str | Sequence[str], spread: bool = True) -> DataFrame:
    """``df`` with each group's rows together and in order; without ``spread`` the groups lie in one partition each already."""
    by = as_list(by)
    return (df.repartition(*by) if spread else df).sortWithinPartitions(*by, *as_list(order))


def _firsts(table: pa.Table, by: Sequence[str]) -> np.ndarray:
    """Where the groups begin in a table that holds each one's rows together."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for c in by:
        ids = table.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= ids[1:] != ids[:-1]
    return np.flatnonzero(new)


def with_run_columns(df: DataFrame, by: Sequence[str], new: Mapping[str, str], kernel: RunKernel) -> DataFrame:
    """``with_group_columns`` for ``arranged`` rows and kernels that take many groups at once.

    The kernel sees whole groups one after the other and each row's place in its group.  A batch of rows costs one call,
    however many groups it holds; only a group that goes on in the next batch is held back.
    """
    by, fields = as_list(by), {f.name: f for f in df.schema.fields}
    for name, kind in new.items():
        fields[name] = T.StructType.fromDDL(f"`{name}` {kind}").fields[0]
    names = list(fields)

    def whole(table: pa.Table, firsts: np.ndarray) -> list[pa.RecordBatch]:
        at = np.arange(table.num_rows) - np.repeat(firsts, np.diff(np.append(firsts, table.num_rows)))
        computed = {n: pa.array(v, ARROW[new[n]], from_pandas=True) for n, v in kernel(table, at).items()}
        return pa.table({n: computed[n] if n in computed else table.column(n) for n in names}).combine_chunks().to_batches()

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            firsts = _firsts(held, by)
            if firsts[-1]:
                yield from whole(held.slice(0, firsts[-1]), firsts[:-1])
                held = held.slice(firsts[-1])
        if held is not None:
            yield from whole(held, np.zeros(1, np.int64))

    return df.mapInArrow(run, T.StructType(list(fields.values())))
