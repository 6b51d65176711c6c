"""Outcomes as a stream against the batch form, under splits, restarts, disorder and late rows."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from panelwright.operators.signal_log import backfill_outcomes
from panelwright.streaming.outcomes import outcome_stream, with_outcomes, write_outcomes

START = dt.date(2020, 1, 1)
SIGNALS, PRICES = "symbol string, date date, direction string", "symbol string, date date, close double"
FULL = SIGNALS + ", outcome_actual double, outcome_correct boolean"


def day(n):
    return START + dt.timedelta(days=n)


@pytest.fixture(scope="module")
def made():
    """Prices with gaps, one symbol that stops, one that starts late, a null symbol, two signals on a day."""
    rng = random.Random(7)
    prices, signals = [], []
    for symbol, first, last in (("A", 0, 90), ("B", 30, 90), ("C", 0, 40), (None, 0, 80)):
        prices += [(symbol, day(n), round(rng.uniform(50, 150), 4)) for n in range(first, last) if rng.random() < 0.8]
        signals += [(symbol, day(n), rng.choice(["BULLISH", "BEARISH"])) for n in range(0, 90) if rng.random() < 0.5]
    return signals + [("A", day(9), "BULLISH"), ("A", day(9), "BEARISH"), ("D", day(5), "BULLISH")], prices


class Feed:
    """Two folders that files arrive in, and a stream that is started anew for every arrival."""

    def __init__(self, spark, root, **options):
        self.spark, self.root, self.options = spark, str(root), options

    def arrive(self, signals, prices):
        for name, rows, schema in (("signals", signals, SIGNALS), ("prices", prices, PRICES)):
            self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{self.root}/{name}")
        streams = [self.spark.readStream.schema(s).parquet(f"{self.root}/{n}") for n, s in (("signals", SIGNALS), ("prices", PRICES))]
        write_outcomes(outcome_stream(*streams, **self.options), f"{self.root}/out", f"{self.root}/progress").awaitTermination()

    def got(self):
        return sorted(map(repr, (tuple(r) for r in self.spark.read.parquet(f"{self.root}/out").select("symbol", "date", "direction", "outcome_actual", "outcome_correct").collect())))


def batch(spark, signals, prices):
    log = spark.createDataFrame([(*s, None, None) for s in signals], FULL)
    # The batch form joins by key, so a null symbol is given a name for it and taken back.
    named = lambda df: df.fillna({"symbol": "none"})
    done = backfill_outcomes(named(log), named(spark.createDataFrame(prices, PRICES))).filter("outcome_actual IS NOT NULL")
    rows = [tuple(r) for r in done.select("symbol", "date", "direction", "outcome_actual", "outcome_correct").collect()]
    return sorted(repr((None if r[0] == "none" else r[0], *r[1:])) for r in rows)


@pytest.mark.parametrize("cuts", [(), (20, 47), (5, 33, 34, 70)])
def test_equals_the_batch_after_every_split(spark, made, tmp_path, cuts):
    signals, prices = made
    feed, before = Feed(spark, tmp_path), -1
    for cut in (*cuts, 200):
        part = lambda rows: [r for r in rows if day(before) < r[1] <= day(cut)]  # noqa: B023, E731
        feed.arrive(part(signals), part(prices))
        before = cut
        so_far = [[r for r in rows if r[1] <= day(cut)] for rows in made]
        assert feed.got() == batch(spark, *so_far)


def test_disorder_within_the_delay(spark, made, tmp_path):
    """Rows that come up to six days late; a closing quote passes the watermark over the rest."""
    rng = random.Random(3)
    signals, prices = ([(r[1] + dt.timedelta(days=rng.randint(0, 6)), r) for r in rows] for rows in made)
    feed, before = Feed(spark, tmp_path, delay="7 days"), day(-1)
    for cut in (day(25), day(60), day(200)):
        feed.arrive(*[[r for at, r in rng.sample(rows, len(rows)) if before < at <= cut] for rows in (signals, prices)])
        before = cut
    assert feed.got() != batch(spark, *made)
    feed.arrive([], [("closing", day(150), 1.0)])
    assert feed.got() == batch(spark, *made)


def test_a_late_row_changes_nothing(spark, made, tmp_path):
    signals, prices = made
    feed = Feed(spark, tmp_path)
    feed.arrive(signals, prices)
    feed.arrive([("A", day(3), "BULLISH")], [("A", day(4), 1.0)])
    assert feed.got() == batch(spark, signals, prices)


def test_waiting_has_an_end(spark, made, tmp_path):
    """Signals of symbols that no longer trade leave without an outcome, each once."""
    feed = Feed(spark, tmp_path, wait_days=40)
    feed.arrive(*made)
    feed.arrive([], [("A", day(400), 1.0)])
    rows = spark.read.parquet(f"{tmp_path}/out")
    assert rows.count() == len(made[0])
    assert rows.filter("symbol = 'D'").first().outcome_actual is None


def test_log_keeps_what_it_has(spark):
    log = spark.createDataFrame([("A", day(0), "BULLISH", 7.5, None), ("A", day(1), "BULLISH", None, None), ("A", day(2), "BEARISH", None, None)], FULL)
    come = spark.createDataFrame([("A", day(0), "BULLISH", 1.0, True), ("A", day(1), "BULLISH", -2.0, False)], FULL)
    got = [(r.outcome_actual, r.outcome_correct) for r in with_outcomes(log, come).orderBy("date").collect()]
    assert got == [(7.5, None), (-2.0, False), (None, None)]
