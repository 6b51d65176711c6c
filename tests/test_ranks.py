"""Places, totals and ranks by range exchange, under any partitioning."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelwright.operators.ranks import distributed_ranks, positions, totals_before


@pytest.fixture(scope="module")
def rows(spark):
    """Half of the values tied, one key with most of the rows, nulls in both."""
    rng = random.Random(1)
    data = [
        (rng.choice("aaaaab") if i % 97 else None, float(rng.randint(0, 40)) if i % 2 else (None if i % 10 == 0 else 7.0), i) for i in range(4000)
    ]
    return spark.createDataFrame(data, "k string, v double, i long").cache()


@pytest.mark.parametrize("partitions", [1, 3, 8])
@pytest.mark.parametrize("descending", [True, False])
def test_ranks_do_not_depend_on_the_partitions(rows, partitions, descending):
    order = F.col("v").desc_nulls_last() if descending else F.col("v").asc_nulls_last()
    got = distributed_ranks(rows, {"v": "rk"}, ["k"], descending, partitions)
    want = rows.withColumn("rk", F.rank().over(Window.partitionBy("k").orderBy(order)))
    assert sorted(map(repr, got.select("i", "rk").collect())) == sorted(map(repr, want.select("i", "rk").collect()))


def test_rank_without_a_key(rows):
    got = distributed_ranks(rows, {"v": "rk"}).agg(F.min("rk"), F.max("rk"), F.count("*")).first()
    assert tuple(got) == (1, 1 + rows.filter("v IS NOT NULL").count(), 4000)


def test_plan_does_not_grow_with_the_rows(spark):
    """Cut points live in the exchange, not in the plan."""

    def size(n):
        df = spark.range(n).select((F.col("id") % 1000).cast("double").alias("v"))
        return len(distributed_ranks(df, {"v": "rk"})._jdf.queryExecution().optimizedPlan().toString())

    assert abs(size(100) - size(1_000_000)) < 200


@pytest.mark.parametrize("partitions", [1, 5])
def test_positions_number_every_row(rows, partitions):
    got = positions(rows, [F.col("k"), F.col("v"), F.col("i")], partitions=partitions).orderBy("position").collect()
    assert [r.position for r in got] == list(range(4000))
    assert [r.i for r in got] == [r.i for r in rows.orderBy("k", "v", "i").collect()]


def test_tied_rows_get_places_of_their_own(spark):
    got = positions(spark.range(500).withColumn("c", F.lit(1)), [F.col("c")]).agg(F.countDistinct("position"), F.max("position")).first()
    assert tuple(got) == (500, 499)


@pytest.mark.parametrize("how", [F.sum, F.bit_xor])
def test_totals_before(rows, how):
    df = rows.withColumn("x", F.pmod(F.xxhash64("i"), F.lit(1000)))
    got = totals_before(df, [F.col("k"), F.col("i")], {"t": "x"}, how, 4).orderBy("k", "i").collect()
    total = 0
    for r in got:
        assert r.t == total
        total = total ^ r.x if how is F.bit_xor else total + r.x


def test_empty_table(rows):
    none = rows.filter("false")
    assert positions(none, [F.col("i")]).count() == totals_before(none, [F.col("i")], {"t": "i"}).count() == distributed_ranks(none, {"v": "rk"}, ["k"]).count() == 0
