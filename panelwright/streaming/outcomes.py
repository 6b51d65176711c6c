"""Outcomes of signals as a stream (K1).

Signals and prices arrive as two streams with event times.  A signal waits in its key's state until the price of the
``horizon``-th row after its entry is there, no earlier row can come any more (the watermark has passed) and the signal is
old enough; then it leaves once.  The state of a key is its waiting signals and the prices since the oldest of them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.dates import add_bdays
from ..functions.expr import as_list
from ..operators.signal_log import HORIZON, MIN_AGE, outcome

DAY_MS = 86_400_000
STATE = "waiting array<int>, sides array<string>, days array<int>, closes array<double>, cutoffs array<int>"


def _settle(waiting, days, cutoffs, final: int, horizon: int):
    """Entry and exit row of each waiting signal, and which have both for good."""
    entry = np.searchsorted(days, waiting, side="left")
    today = cutoffs[final - 1] if final else np.iinfo(np.int32).min
    return entry, (entry + horizon < final) & (waiting <= today)


def outcome_stream(
    signals: DataFrame, prices: DataFrame, delay: str = "0 seconds", min_age: int = MIN_AGE, horizon: int = HORIZON,
    wait_days: int | None = None, by: Sequence[str] = ("symbol",), date: str = "date",
) -> DataFrame:
    """``by, date, direction, outcome_actual, outcome_correct`` of each signal, once, as ``backfill_outcomes`` fills them.

    ``signals`` and ``prices`` are streams.  Rows may come out of order, and one stream behind the other, within ``delay``;
    one that is not dated after the newest day of earlier batches less ``delay`` is late and left out, as Spark does.
    With ``wait_days`` a signal that is older and still open leaves without an outcome and frees its state.  Of several
    prices of one day the last to arrive counts; null keys are a key of their own, rows without a date are left out.
    """
    by = as_list(by)
    at = F.col(date).cast("timestamp")
    none = lambda t: F.lit(None).cast(t)
    asked = signals.filter(F.col(date).isNotNull()).select(
        *by, at.alias("at"), F.unix_date(F.to_date(date)).alias("day"), "direction", none("double").alias("close"), none("int").alias("cutoff")
    )
    quoted = prices.filter(F.col(date).isNotNull() & F.col("close").isNotNull()).select(
        *by, at.alias("at"), F.unix_date(F.to_date(date)).alias("day"), none("string").alias("direction"), "close",
        F.unix_date(add_bdays(F.to_date(date), -min_age)).alias("cutoff"),
    )
    both = asked.unionByName(quoted).withWatermark("at", delay)
    keys = ", ".join(f"`{k}` {both.schema[k].dataType.simpleString()}" for k in by)
    out_schema = f"{keys}, day int, direction string, entry double, exit double"

    def wait(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else ([], [], [], [], [])
        waiting, sides, book = list(held[0]), list(held[1]), dict(zip(held[2], zip(held[3], held[4], strict=True), strict=True))
        for f in frames:
            quoted = f["close"].notna()
            days, closes, cutoffs = (f.loc[quoted, c].tolist() for c in ("day", "close", "cutoff"))
            book.update(zip(days, zip(closes, map(int, cutoffs), strict=True), strict=True))
            waiting += f.loc[~quoted, "day"].tolist()
            sides += f.loc[~quoted, "direction"].tolist()
        days = np.array(sorted(book), np.int64)
        closes, cutoffs = (np.array([book[d][i] for d in days.tolist()]) for i in (0, 1))
        waiting, sides = np.array(waiting, np.int64), np.array(sides, object)

        seen = state.getCurrentWatermarkMs() // DAY_MS
        final = int(np.searchsorted(days, seen, side="right"))
        entry, done = _settle(waiting, days, cutoffs, final, horizon)
        over = ~done & (waiting + wait_days < seen) if wait_days is not None else np.zeros(len(waiting), bool)
        left = done | over
        if left.any():
            prices_at = lambda i: np.where(done, closes[np.minimum(i, len(closes) - 1)], np.nan) if len(closes) else np.full(len(done), np.nan)
            out = pd.DataFrame({"day": waiting, "direction": sides, "entry": prices_at(entry), "exit": prices_at(entry + horizon)})[left]
            for k, v in zip(reversed(by), reversed(key), strict=True):
                out.insert(0, k, v)
            yield out

        waiting, sides = waiting[~left], sides[~left]
        since = waiting.min() if len(waiting) else seen + 1
        keep = (days >= since) | (days > seen)
        days, closes, cutoffs = days[keep], closes[keep], cutoffs[keep]
        if not len(waiting) and not len(days):
            state.remove()
            return
        state.update((waiting.tolist(), sides.tolist(), days.tolist(), closes.tolist(), [int(c) for c in cutoffs]))
        # The next day on which a row that is here becomes final, or a signal gives up.
        wake = [int(d) for d in days[days > seen][:1]] + ([int(waiting.min()) + wait_days + 1] if wait_days is not None and len(waiting) else [])
        if wake:
            state.setTimeoutTimestamp(min(wake) * DAY_MS - 1)

    found = both.groupBy(*by).applyInPandasWithState(wait, out_schema, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return found.select(*by, F.date_from_unix_date("day").alias(date), "direction", *[c.alias(n) for n, c in outcome("entry", "exit").items()])


def write_outcomes(outcomes: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Parquet file sink, each outcome exactly once; ``once`` takes what is there, the last watermark included, and ends."""
    writer = outcomes.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def with_outcomes(log: DataFrame, outcomes: DataFrame, by: Sequence[str] = ("symbol",), date: str = "date") -> DataFrame:
    """The log with the outcomes that have come; those it already has stay as they are."""
    on = [*as_list(by), date, "direction"]
    new = {c: f"__{c}" for c in ("outcome_actual", "outcome_correct")}
    come = outcomes.groupBy(*on).agg(*[F.first(c).alias(n) for c, n in new.items()])
    open_row = F.col("outcome_actual").isNull()
    filled = {c: F.when(open_row, F.coalesce(n, c)).otherwise(F.col(c)) for c, n in reversed(new.items())}
    return log.join(come, on, "left").withColumns(filled).drop(*new.values())
