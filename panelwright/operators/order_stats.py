"""Ranks of a value among the rows before it, by counting in merged sorted blocks.

How many of the first ``e`` values are smaller is a question of time and value.  The values are kept sorted in blocks of
1, 2, 4, ... rows, each level merged from the one before; a prefix is at most one block per level (the binary digits of
its length), and within a block the count is a binary search.  The last ``w`` rows are one prefix less another.  So all
rows of a key take n log n work at any window, and no row holds its past.  The group is a key's days.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.expr import as_list
from ..functions.grouped import with_group_columns


def prefix_counts(ranks: np.ndarray, ends: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many of the first ``ends[i]`` ranks are below ``asked[i]``, and how many are not above."""
    n = len(ranks)
    below, upto = np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64)
    at, width, size, runs = np.arange(n), n + 1, 1, ranks.astype(np.int64)
    while size <= n:
        keys = at // size * width + runs
        some = np.flatnonzero(ends // size % 2)
        block = ends[some] // size - 1
        sought = block * width + asked[some]
        below[some] += np.searchsorted(keys, sought, side="left") - block * size
        upto[some] += np.searchsorted(keys, sought, side="right") - block * size
        size *= 2
        keys = at // size * width + runs
        keys.sort(kind="stable")  # two sorted halves per block: a merge
        runs = keys - at // size * width
    return below, upto


def percentiles(values: np.ndarray, window: int | None = None, min_rows: int = 1) -> np.ndarray:
    """Average-tie percentile of each value among the last ``window`` rows (all so far without one), NaN standing for none.

    Rows without a value fill a place in the window but are not counted; with fewer than ``min_rows`` counted the
    result is NaN.
    """
    out, some = np.full(len(values), np.nan), ~np.isnan(values)
    seen = np.cumsum(some)
    ranks = np.unique(values[some], return_inverse=True)[1]
    hi = seen[some]
    before = np.zeros(len(values), np.int64)
    if window is not None:
        before[window:] = seen[:-window]
    lo = before[some]
    less, upto = prefix_counts(ranks, hi, ranks)
    if window is not None:
        less0, upto0 = prefix_counts(ranks, lo, ranks)
        less, upto = less - less0, upto - upto0
    size = hi - lo
    out[some] = np.where(size >= min_rows, (less + (upto - less + 1) / 2.0) / np.maximum(size, 1), np.nan)
    return out


def rank_so_far(
    df: DataFrame, columns: Mapping[str, str], window: int | None = None, min_rows: int = 1, by: Sequence[str] = ("symbol",), order: str = "date"
) -> DataFrame:
    """Adds ``{new: column}``, the column's percentile among the key's last ``window`` rows, or all rows so far.

    NULL where the value is NULL or fewer than ``min_rows`` values are there.
    """

    def kernel(table: pa.Table) -> dict[str, np.ndarray]:
        return {new: percentiles(table.column(c).to_numpy().astype(float), window, min_rows) for new, c in columns.items()}

    return with_group_columns(df, as_list(by), order, dict.fromkeys(columns, "double"), kernel)
