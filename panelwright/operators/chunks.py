"""Blocks and chunks of a key's days: where chunks may lie, which are drawn and how they score (V4).

A key is one row with its days as arrays, bounded by its days: first those that are not out of fold, then those that are, each by
date.  Nothing is multiplied: a chunk is a place in the arrays, and only while a slice of keys is scored do its rows lie
side by side, at most ``AT_ONCE`` at a time but for one key's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Days of keys, and days in chunks, that a task holds side by side.
AT_ONCE = 1 << 18

#: Rows a chunk needs for its metrics; blocks and out-of-fold rows a key needs for chunks.
MIN_ROWS, MIN_BLOCKS, MIN_OOF = 5, 4, 30

DAYS = "__days array<int>, __pred array<double>, __actual array<double>, __free int"
PLACES = "__len int, __good array<boolean>"
DRAWN = "__places array<int>"
SCORED = "chunk bigint, win_rate double, pct_return double, n_trades bigint, ic double, n_rows bigint, is_oof boolean, shortfall bigint"


def key_rows(preds: DataFrame, by: Sequence[str], date: str) -> DataFrame:
    """One row per key with its days; rows without a key, a date or a fold mark have no place among them."""
    known = preds.dropna("any", subset=[*by, date, "is_oof"])
    day = F.datediff(F.col(date), F.lit("1970-01-01").cast("date"))
    row = F.struct(F.col("is_oof").alias("oof"), day.alias("day"), F.col("pred").cast("double").alias("pred"), F.col("actual").cast("double").alias("actual"))
    return known.groupBy(*by).agg(F.collect_list(row).alias("__rows"))


def mapped(df: DataFrame, fn: Callable, schema: str, by: Sequence[str], drop: Sequence[str] = (), lists: str = "__days") -> DataFrame:
    """``fn(batch) -> (keys, columns)`` on slices of key rows: the columns of ``schema`` and those of the keys they belong to,
    of which only ``by`` is kept where ``drop`` is None."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    new = _parse_datatype_string(schema)
    old = [f for f in df.schema.fields if (f.name in by if drop is None else f.name not in drop)]
    out = StructType([*old, *new.fields])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            ends = np.cumsum(batch.column(lists).value_lengths().fill_null(0).to_numpy())
            at = 0
            while at < batch.num_rows:
                held = ends[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(ends, held + AT_ONCE, "right")))
                part = batch.slice(at, to - at)
                keys, columns = fn(part)
                kept = [part.column(f.name).take(pa.array(keys)).cast(arrow.field(f.name).type) for f in old]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(columns[f.name], arrow.field(f.name).type) for f in new.fields)], schema=arrow)
                at = to

    return df.mapInArrow(run, out)


def listed(lengths, values) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values if isinstance(values, pa.Array) else pa.array(values))


class Days:
    """The days of a slice of keys, one key after the other."""

    def __init__(self, n, free, day, pred: pa.Array, actual: pa.Array):
        self.n, self.free, self.day = n, free, day
        self.first = np.cumsum(n) - n
        self.key = np.repeat(np.arange(len(n)), n)
        self.oof = np.arange(len(day)) - self.first[self.key] >= free[self.key]
        self.known = [~x.is_null().to_numpy(zero_copy_only=False) for x in (pred, actual)]
        self.pred, self.actual = (x.fill_null(0.0).to_numpy(zero_copy_only=False) for x in (pred, actual))

    @classmethod
    def of(cls, batch) -> Days:
        days, pred, actual = (batch.column(c) for c in ("__days", "__pred", "__actual"))
        return cls(days.value_lengths().to_numpy(), batch.column("__free").to_numpy().astype(np.int64), days.flatten().to_numpy().astype(np.int64), pred.flatten(), actual.flatten())

    def blocks(self, gap: int):
        """First and last row of every block, its key and its number in the key."""
        rows = np.flatnonzero(self.oof)
        key = self.key[rows]
        new = np.ones(len(rows), bool)
        new[1:] = (key[1:] != key[:-1]) | (np.diff(self.day[rows]) > gap)
        at = np.flatnonzero(new)
        first, last = rows[at], rows[np.append(at[1:], len(rows)) - 1] if len(at) else rows
        of = key[at]
        return first, last, of, np.arange(len(at)) - np.searchsorted(of, of)

    def entries(self, hold: int, min_signal: float):
        """Rows that qualify, and for each which of them is the next that is free if it is entered.

        Of days in order, the first that is no earlier than the business day ``hold`` after an entry, or after the Friday
        before it; a weekend day comes after that Friday.
        """
        rows = np.flatnonzero(self.known[0] & ~(np.abs(self.pred) < min_signal))  # NaN is the largest number
        monday = self.day[rows] - 4
        bday = monday // 7 * 5 + np.minimum(monday % 7, 4)
        group = (self.key[rows] * 2 + self.oof[rows]) << 40
        at = np.arange(len(rows))
        if hold < 1:
            return rows, at + 1
        half = bday * 2 + (monday % 7 >= 5)
        return rows, np.maximum(at + 1, np.searchsorted(group + half + (1 << 39), group + 2 * (bday + hold) + (1 << 39)))

    def score(self, first, last, hold: int, min_signal: float) -> dict:
        """Metrics of the spans of rows from ``first`` to ``last``, each replayed without overlap."""
        rows, after = self.entries(hold, min_signal)
        ends = np.append(rows, len(self.day))
        after = np.append(after, len(rows))
        # Rows of a span's other kind or of another key lie behind its last row.
        at, n, wins, known, total = np.searchsorted(rows, first), *(np.zeros(len(first), np.int64) for _ in range(3)), np.zeros(len(first))
        live = np.flatnonzero(ends[at] <= last)
        while len(live):
            row = rows[at[live]]
            gain = np.where(~(self.pred[row] <= 0), 1.0, -1.0) * self.actual[row]
            has = self.known[1][row]
            n[live] += 1
            known[live] += has
            wins[live] += has & ~(gain <= 0)
            total[live] += np.where(has, gain, 0.0)
            at[live] = after[at[live]]
            live = live[ends[at[live]] <= last[live]]
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            none = known == 0
            return {
                "n_trades": n, "win_rate": pa.array(wins / np.maximum(known, 1), mask=none), "pct_return": pa.array((np.exp(total) - 1) * 100, mask=none),
                "ic": self.correlations(first, last), "n_rows": last - first + 1,
            }

    def correlations(self, first, last):
        """Correlation of forecast and outcome in each span; zero where either does not vary."""
        size, out = last - first + 1, np.zeros(len(first))
        a = 0
        while a < len(first):
            b = max(a + 1, a + int(np.searchsorted(np.cumsum(size[a:]), AT_ONCE, "right")))
            n = size[a:b]
            own = np.repeat(np.arange(b - a), n)
            row = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + first[a:b][own]
            both = self.known[0][row] & self.known[1][row]
            row, own = row[both], own[both]
            new = np.ones(len(own), bool)
            new[1:] = own[1:] != own[:-1]
            origin = np.zeros(b - a, np.int64)
            origin[own[new]] = row[new]
            total = lambda v: np.bincount(own, v, b - a)  # noqa: B023, E731
            count = np.maximum(np.bincount(own, minlength=b - a), 1)
            # From the first value on, so that what does not vary has no variance.
            x, y = (v[row] - v[origin][own] for v in (self.pred, self.actual))
            x, y = (v - (total(v) / count)[own] for v in (x, y))
            below = np.sqrt(total(x * x) / count * (total(y * y) / count))
            out[a:b] = np.where(below == 0, 0.0, total(x * y) / count / np.where(below == 0, 1.0, below))
            a = b
        return out


def places(rows: DataFrame, by: Sequence[str], gap: int, hold: int, min_signal: float) -> DataFrame:
    """Adds the days in order, the length of chunks (of the median block; zero where a key has none) and which places score.

    A key has chunks with four blocks, 30 out-of-fold rows and more free rows than a chunk.  A place scores if its chunk has
    five rows and a trade and touches no block: as many blocks have ended before its first day as have started by its last.
    """

    def run(batch):
        lists = batch.column("__rows")
        n = lists.value_lengths().to_numpy()
        oof, day, pred, actual = (lists.flatten().field(i) for i in range(4))
        oof, key = oof.to_numpy(zero_copy_only=False), np.repeat(np.arange(len(n)), n)
        order = pa.array(np.lexsort((actual.to_numpy(zero_copy_only=False), pred.to_numpy(zero_copy_only=False), day.to_numpy(), oof, key)))
        day, pred, actual = (c.take(order) for c in (day, pred, actual))
        free = n - np.bincount(key[oof], minlength=len(n))
        days = Days(n, free, day.to_numpy().astype(np.int64), pred, actual)
        first, last, of, _ = days.blocks(gap)
        count = np.bincount(of, minlength=len(n))
        begin = np.cumsum(count) - count
        sizes = np.append((last - first + 1)[np.lexsort((last - first, of))], 0)
        half = lambda k: sizes[np.minimum(begin + k, len(sizes) - 1)]
        size = (half(np.maximum(count - 1, 0) // 2) + half(count // 2)) // 2
        size = np.where((count >= MIN_BLOCKS) & (n - free >= MIN_OOF) & (free > size), size, 0)
        n_places = np.where(size > 0, free - size, 0)
        own = np.repeat(np.arange(len(n)), n_places)
        start = np.arange(len(own)) - np.repeat(np.cumsum(n_places) - n_places, n_places) + days.first[own]
        end = start + size[own] - 1
        code = lambda k, row: (k << 40) + days.day[row] + (1 << 39)
        started = np.searchsorted(code(of, first), code(own, end), "right")
        ended = np.searchsorted(code(of, last), code(own, start), "left")
        enters = np.append(days.entries(hold, min_signal)[0], len(days.day))
        good = (started == ended) & (size[own] >= MIN_ROWS) & (enters[np.searchsorted(enters[:-1], start)] <= end)
        return np.arange(len(n)), {
            "__days": listed(n, day), "__pred": listed(n, pred), "__actual": listed(n, actual), "__free": free, "__len": size, "__good": listed(n_places, good),
        }

    return mapped(rows, run, f"{DAYS}, {PLACES}", by, ["__rows"], "__rows")


def draws(keys: DataFrame, by: Sequence[str], n_boot: int, seed: int) -> DataFrame:
    """Adds the first ``n_boot`` draws of each key that hit a place which scores; none where no place does.

    Draw ``i`` is a hash of key, ``i`` and seed over the key's places, so the result does not depend on tasks.
    """

    def run(batch):
        from hashlib import md5

        tails: list[bytes] = []

        def drawn(name: bytes, good):
            taken, start, more = [np.zeros(0, np.int64)], 0, 2 * n_boot
            while good.any() and sum(map(len, taken)) < n_boot:
                tails.extend(f"|{i}|{seed}".encode() for i in range(len(tails), start + more))
                hashes = b"".join([md5(name + t).digest() for t in tails[start : start + more]])
                place = (np.frombuffer(hashes, ">u8")[::2] >> np.uint64(4)) % np.uint64(len(good))
                taken.append(place[good[place]].astype(np.int64))
                start, more = start + more, 2 * more
            return np.concatenate(taken)[:n_boot]

        lists = batch.column("__good")
        good, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(lists.value_lengths().to_numpy())
        names = batch.column("__name").to_pylist()
        found = [drawn(name.encode(), good[a:b]) for name, a, b in zip(names, np.append(0, ends), ends, strict=False)]
        return np.arange(len(names)), {"__places": listed([len(x) for x in found], np.concatenate([np.zeros(0, np.int32), *found]).astype(np.int32))}

    return mapped(keys.withColumn("__name", F.concat_ws("|", *by)), run, DRAWN, by, ["__name", "__good"])


def scores(keys: DataFrame, by: Sequence[str], n_boot: int, gap: int, hold: int, min_signal: float) -> DataFrame:
    """Every block that scores and every drawn chunk with its metrics; a key with chunks but without a draw is one row."""

    def run(batch):
        days = Days.of(batch)
        first, last, of, number = days.blocks(gap)
        size, lists = batch.column("__len").to_numpy().astype(np.int64), batch.column("__places")
        drawn, place = lists.value_lengths().to_numpy(), lists.flatten().to_numpy().astype(np.int64)
        own = np.repeat(np.arange(len(size)), drawn)
        start = days.first[own] + place
        some, back = np.unique(start, return_inverse=True)
        key = days.key[some] if len(some) else np.zeros(0, np.int64)
        found = days.score(np.concatenate([first, some]), np.concatenate([last, some + size[key] - 1]), hold, min_signal)
        n = found["n_trades"]
        blocks = np.flatnonzero((n[: len(first)] > 0) & (found["n_rows"][: len(first)] >= MIN_ROWS))
        empty = np.flatnonzero((size > 0) & (drawn == 0))
        keys = np.concatenate([of[blocks], own, empty])
        take = pa.array(np.concatenate([blocks, len(first) + back, np.zeros(len(empty), np.int64)]), mask=np.arange(len(keys)) >= len(keys) - len(empty))
        chunk = np.concatenate([number[blocks], np.arange(len(own)) - np.repeat(np.cumsum(drawn) - drawn, drawn) + 1, np.zeros(len(empty), np.int64)])
        is_oof = np.arange(len(keys)) < len(blocks)
        columns = {c: (v if isinstance(v, pa.Array) else pa.array(v)).take(take) for c, v in found.items()}
        return keys, columns | {
            "chunk": pa.array(chunk, mask=np.arange(len(keys)) >= len(keys) - len(empty)), "is_oof": is_oof, "shortfall": pa.array(n_boot - drawn[keys], mask=is_oof),
        }

    return mapped(keys, run, SCORED, by, None)
