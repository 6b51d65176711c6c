"""Sliding statistics and rolling z-scores of a whole feature table.

Spark recomputes a sliding frame for every row, and window expressions for a hundred features make a plan that takes longer
to build than to run.  Here the days of many keys are one array per feature, a key's rows after each other.

Scores: the rows of a key are cut into blocks as long as the window, so that a window is the end of one block and the start
of the next; sums that grow from both ends of each block give the moments of all windows.  The work per row does not depend
on the window, nothing is subtracted from running totals, and the plan does not grow with the features.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from decimal import ROUND_HALF_UP, Decimal, localcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.expr import EPS, TRADING_DAYS, as_list
from ..functions.grouped import arranged, with_run_columns

# Rows of a block within which an exponential mean is one product of matrices.
EMA_BLOCK = 32


def _plain(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy().astype(float, copy=False)


def blocks(at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Place of each row where every key starts a block of ``n`` rows, and which blocks start a key.

    ``at`` is each row's place in its key.
    """
    firsts = np.flatnonzero(at == 0)
    lengths = np.diff(np.append(firsts, len(at)))
    each = -(-lengths // n)
    begin = np.cumsum(each) - each
    starts = np.zeros(int(each.sum()), bool)
    starts[begin] = True
    return np.repeat(begin * n, lengths) + at, starts


def _last(x: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` rows up to each row, NaN before the first."""
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(n - 1, np.nan), x]), n)


def _around(x: np.ndarray, n: int) -> np.ndarray:
    """The last ``n`` rows less their mean; exactly zero where they are all the same."""
    off = _last(x, n) - x[:, None]
    return off - off.mean(axis=1, keepdims=True)


def _full(values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """NaN where a key does not have ``n`` rows yet."""
    return np.where(at >= n - 1, values, np.nan)


def _std(at, n, x):
    return _full(np.sqrt(np.square(_around(x, n)).sum(axis=1) / (n - 1)), at, n)


def _corr(at, n, a, b):
    none = np.isnan(a) | np.isnan(b)
    a, b = (_around(np.where(none, np.nan, x), n) for x in (a, b))
    spread = np.sqrt(np.square(a).mean(axis=1) * np.square(b).mean(axis=1))
    return _full((a * b).mean(axis=1) / np.where(spread == 0, np.nan, spread), at, n)


def _falling(at, n, *columns):
    fall = np.logical_and.reduce([a > b for a, b in zip(columns, columns[1:], strict=False)])
    return _full(_last(fall.astype(float), n).mean(axis=1), at, n)


def _lag(at, n, x):
    return np.where(at >= n, np.concatenate([np.full(min(n, len(x)), np.nan), x[: max(len(x) - n, 0)]]), np.nan)


def ema(at: np.ndarray, span: int, x: np.ndarray) -> np.ndarray:
    """Exponential mean with weight ``2 / (span + 1)`` from a key's first row on (I13); the values have no gaps."""
    a = 2.0 / (span + 1)
    keep, place, starts = 1.0 - a, *blocks(at, EMA_BLOCK)
    terms = np.zeros(len(starts) * EMA_BLOCK)
    terms[place] = np.where(np.isnan(x), 0.0, np.where(at == 0, x, a * x))
    age = np.arange(EMA_BLOCK)[None, :] - np.arange(EMA_BLOCK)[:, None]
    inside = terms.reshape(-1, EMA_BLOCK) @ np.where(age >= 0, keep ** np.maximum(age, 0), 0.0)
    before, end, fades = np.zeros(len(starts)), 0.0, keep**EMA_BLOCK
    for i, (start, own) in enumerate(zip(starts.tolist(), inside[:, -1].tolist(), strict=True)):
        before[i] = 0.0 if start else end
        end = own + fades * before[i]
    out = inside + before[:, None] * keep ** np.arange(1, EMA_BLOCK + 1)
    return np.where(np.isnan(x), np.nan, out.ravel()[place])


def _macd(at, n, x):
    """Histogram of the usual spans; ``n`` is the signal's."""
    line = ema(at, 12, x) - ema(at, 26, x)
    return line - ema(at, n, line)


#: Statistics of the last ``n`` rows, all of them filled: ``fn(at, n, *columns)``.
ROLLED: dict[str, Callable] = {
    "mean": lambda at, n, x: _full(_last(x, n).mean(axis=1), at, n),
    "sum": lambda at, n, x: _full(_last(x, n).sum(axis=1), at, n),
    "min": lambda at, n, x: _full(_last(x, n).min(axis=1), at, n),
    "gain": lambda at, n, x: _full(_last(np.maximum(x, 0.0), n).mean(axis=1), at, n),
    "loss": lambda at, n, x: _full(_last(np.maximum(-x, 0.0), n).mean(axis=1), at, n),
    "std": _std, "corr": _corr, "falling": _falling, "lag": _lag, "macd": _macd,
}


def rolled_columns(df: DataFrame, columns: Mapping[str, tuple[str, int, Sequence[str]]], by: Sequence[str] = ("symbol",), order: str = "date") -> DataFrame:
    """Adds ``{new: (kind, n, sources)}`` of ``ROLLED``; a source may be a column that was added before it.

    ``df`` is partitioned by ``by`` and stays so: its rows leave in the order of key and date.
    """
    columns = dict(columns)

    def kernel(table: pa.Table, at: np.ndarray) -> dict[str, np.ndarray]:
        out: dict[str, np.ndarray] = {}
        with np.errstate(invalid="ignore", over="ignore", divide="ignore"):
            for new, (kind, n, sources) in columns.items():
                out[new] = ROLLED[kind](at, n, *(out[c] if c in out else _plain(table, c) for c in sources))
        return out

    return with_run_columns(arranged(df, by, order, spread=False), by, dict.fromkeys(columns, "double"), kernel)


def _middle(x: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Median of each block's values, 0 without any; NaN stands for none."""
    ranked = np.sort(x, axis=1)
    lower, upper = (np.take_along_axis(ranked, np.maximum(i, 0)[:, None], axis=1)[:, 0] for i in ((count - 1) // 2, np.minimum(count // 2, x.shape[1] - 1)))
    return np.where(count == 0, 0.0, np.where(count % 2 == 1, lower, (lower + upper) / 2))


def rolling_scores(x: np.ndarray, at: np.ndarray, n: int, need: int) -> np.ndarray:
    """``(x - mean) / (std + eps)`` over the last ``n`` rows of a key, NaN with fewer than ``need`` values there.

    Sums are taken around the block's median, which one far value does not move.
    """
    place, starts = blocks(at, n)
    cut = np.full(len(starts) * n, np.nan)
    cut[place] = x
    cut = cut.reshape(-1, n)
    with np.errstate(invalid="ignore", over="ignore"):
        some = ~np.isnan(cut)
        middle = _middle(cut, some.sum(axis=1))
        off = np.where(some, cut - middle[:, None], 0.0)
        parts = (some.astype(float), off, off * off)

        def moments(rows: np.ndarray, back: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Count, mean and summed squares around it of rows with the rows of their block before them (after them: ``back``)."""
            sums = [(np.cumsum(p[:, ::-1], axis=1)[:, ::-1] if back else np.cumsum(p, axis=1)).reshape(-1)[rows] for p in parts]
            c, s, q = sums
            mean = s / np.maximum(c, 1)
            return c, mean + middle[rows // n], np.maximum(q - s * mean, 0.0)

        nb, mb, qb = moments(place, back=False)
        # What the window still holds of the block before: the row n - 1 back to that block's end; nothing where it is one block.
        older = (at >= n) & ((at + 1) % n != 0)
        na, ma, qa = (np.where(older, m, 0.0) for m in moments(np.where(older, place - n + 1, 0), back=True))
        total, gap = na + nb, np.where((na > 0) & (nb > 0), mb - ma, 0.0)
        mean = np.where(na > 0, ma, mb) + gap * nb / np.maximum(total, 1)
        squares = np.where(na > 0, qa, 0.0) + np.where(nb > 0, qb, 0.0) + gap * gap * na * nb / np.maximum(total, 1)
        std = np.sqrt(squares / np.where(total > 1, total - 1, np.nan))
        return np.where(total >= need, (x - mean) / (std + EPS), np.nan)


def half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """``functions.expr.r`` of an array: the decimal that a value is written as, rounded half away from zero.

    Only a value on a border, or too large for its scaled form to be exact, is looked at as a decimal.
    """
    scale = 10.0**digits
    with np.errstate(invalid="ignore", over="ignore"):
        size = np.abs(x) * scale
        whole = np.floor(size)
        out = np.copysign((whole + (size - whole >= 0.5)) / scale, x)
        unsure = np.isfinite(x) & ((np.abs(size - whole - 0.5) < 1e-4) | (size > 2.0**36))
    for i in np.flatnonzero(unsure):
        with localcontext(prec=400):
            out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return np.where(np.isfinite(x), out, x) + 0.0


def rolling_z_all(
    df: DataFrame,
    columns: Sequence[str],
    n: int = TRADING_DAYS,
    min_rows: int | None = None,
    by: Sequence[str] = ("symbol",),
    order: str = "date",
    gaps: Mapping[str, tuple[str, str]] | None = None,
    in_order: bool = False,
    digits: int | None = None,
) -> DataFrame:
    """Replaces double columns by (x - mean) / (std + eps) over the last ``n`` rows, half of them filled (I8).

    ``gaps`` adds ``{name: (a, b)}``, the score of scored ``a`` less ``b`` (I24): ``b`` may be another scored column
    or one that arrived as a score.  ``in_order``: the rows are as ``rolled_columns`` left them.
    ``digits`` rounds what leaves; Spark's own rounding costs more than the scores.
    """
    columns, need = list(columns), n // 2 if min_rows is None else min_rows
    gaps = dict(gaps or {})
    names = [*columns, *gaps]
    if not names:
        return df

    def kernel(table: pa.Table, at: np.ndarray) -> dict[str, np.ndarray]:
        out = {c: rolling_scores(_plain(table, c), at, n, need) for c in columns}
        side = lambda c: out[c] if c in out else _plain(table, c)
        out |= {g: rolling_scores(side(a) - side(b), at, n, need) for g, (a, b) in gaps.items()}
        return out if digits is None else {c: half_up(x, digits) for c, x in out.items()}

    return with_run_columns(df if in_order else arranged(df, by, order), as_list(by), dict.fromkeys(names, "double"), kernel)
