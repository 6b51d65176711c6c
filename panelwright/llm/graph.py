"""Connected components of an edge table by alternating large-star and small-star rounds.

Each round is a few joins and aggregations on tables in the shared folder; nothing of the graph comes to the driver but
the number and a checksum of its edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _least(edges: DataFrame) -> DataFrame:
    """Smallest neighbour of each ``a``; written, so that joins with it deal both sides anew and split a hub's rows."""
    return materialize(edges.groupBy("a").agg(F.min("b").alias("m")), "least-neighbours")


def large_star(edges: DataFrame) -> DataFrame:
    """Connects the larger neighbours of each node to its smallest neighbour or to itself."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _least(both)
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Connects each node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = _least(down)
    others = down.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """``a, b``: each node with an edge and the smallest node of its component, without the smallest node's own row.

    ``edges`` has ``a, b`` of an orderable type; loops and repeated edges do no harm, nulls are left out.
    """
    now = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before or not state[0]:
            return now
        before = state
        now = materialize(small_star(materialize(large_star(now), "large-star")), "small-star")
    raise RuntimeError(f"components did not settle in {rounds} rounds")
