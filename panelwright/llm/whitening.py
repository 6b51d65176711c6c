"""Embedding whitening with a weighted multiplicity covariance.

Identical integer vectors are grouped; a distinct vector takes part in the fit with its count, or once, as its weight.
Sums are exact; the covariance is a weighted matrix product of centred vectors, one partial matrix per task, added up by
entry before anything reaches the driver, which sees numbers of the order of the dimensions only.  Each distinct vector is
whitened once, and the rows get theirs by a join on a digest of the vector, so that a vector that a third of all rows hold
is one row of the table joined.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, query, table

# The grid that entries are put on, and the components returned.
SCALE, OFFSET, COMPONENTS = 1024, 100_000, 8

#: The driver solves for the eigenvectors of a matrix of so many rows at most.
MAX_DIMENSIONS = 2048

#: Scaled entries beyond this are held there, as a long has no room for them.
EDGE = 9e18

#: Vectors that are multiplied at a time.
ROWS = 4096

#: Eigenvalues of at most this share of the largest, times the dimensions, are rounding, not directions.
FLAT = float(np.finfo(float).eps)


@dataclass(frozen=True)
class Fit:
    """What the fit list gave: its weight ``n``, exact ``sums``, unit ``axes`` (a column each), their ``values`` and ``trace``."""

    n: int
    sums: tuple[int, ...]
    axes: np.ndarray
    values: np.ndarray
    trace: float


def on_grid(vector: str) -> Column:
    """``floor(1024 * c) + 100000`` of every entry as a long."""
    held = lambda c: F.greatest(F.lit(-EDGE), F.least(F.lit(EDGE), c.cast("double") * SCALE))
    return F.transform(vector, lambda c: F.floor(held(c)).cast("long") + F.lit(OFFSET).cast("long"))


def usable(vector: str) -> Column:
    """Neither null nor with a null, NaN or infinite entry."""
    c = lambda x: x.cast("double")
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(c(x)) & (F.abs(c(x)) < float("inf"))), F.lit(False))


def digest(x: str) -> Column:
    """SHA-256 of a vector of longs."""
    return F.unhex(F.sha2(F.array_join(x, ",").cast("binary"), 256))


def distinct_vectors(rows: DataFrame, weights: str = "counts") -> DataFrame:
    """``key, x, copies, weight``: each distinct vector once, written."""
    groups = rows.groupBy("x").agg(F.count(F.lit(1)).alias("copies"))
    weight = {"counts": F.col("copies"), "one": F.lit(1).cast("long")}[weights]
    return materialize(groups.select(digest("x").alias("key"), "x", "copies", weight.alias("weight")), "distinct-vectors")


def matrix(column) -> np.ndarray:
    """A list column whose lists are all of one length, as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def pieces(batches):
    return (b.slice(a, ROWS) for b in batches for a in range(0, b.num_rows, ROWS))


def exact_sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """Total weight and the weighted sum of each dimension, as exact integers."""

    def run(batches):
        import pyarrow as pa

        n, sums = 0, None
        for b in pieces(batches):
            x, w = matrix(b.column("x")), b.column("weight").to_numpy()
            n += int(w.sum())
            most = float(np.abs(x.astype(float)).max(initial=0)) * float(w.sum())
            part = w @ x if most < 2**62 else w.astype(object) @ x.astype(object)
            sums = [int(v) for v in part] if sums is None else [a + int(v) for a, v in zip(sums, part, strict=True)]
        if sums is not None:
            values = [Decimal(v) for v in (n, *sums)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), pa.array(values, pa.decimal128(38, 0))], ["at", "value"])

    found = vectors.mapInArrow(run, "at int, value decimal(38,0)").groupBy("at").agg(F.sum("value").alias("value")).collect()
    n, *sums = (int(r["value"]) for r in sorted(found, key=lambda r: r["at"]))
    return n, sums


def centred(x: np.ndarray, n: int, sums) -> np.ndarray:
    """``x - sums / n``: the whole part of the mean is taken off as an integer, so no digit is lost to its size."""
    whole = [s // n for s in sums]
    rest = np.array([(s % n) / n for s in sums])
    small = max(map(abs, whole), default=0) < 2**61 and float(np.abs(x.astype(float)).max(initial=0)) < 2**61
    near = (x - np.array(whole)) if small else x.astype(object) - np.array(whole, dtype=object)
    return near.astype(float) - rest


def covariance(vectors: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """Sum of weight times the outer product of each centred vector, over ``n``."""
    size = len(sums)

    def run(batches):
        import pyarrow as pa

        total = np.zeros((size, size))
        for b in pieces(batches):
            c = centred(matrix(b.column("x")), n, sums)
            total += (c * b.column("weight").to_numpy()[:, None].astype(float)).T @ c
        for i in range(size):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([total[i, i:].tolist()], pa.list_(pa.float64()))], ["i", "tail"])

    tails = vectors.mapInArrow(run, "i int, tail array<double>").select("i", F.posexplode("tail").alias("j", "value"))
    cells = tails.groupBy("i", "j").agg(F.sum("value").alias("value")).toPandas()
    out = np.zeros((size, size))
    out[cells["i"], cells["i"] + cells["j"]] = cells["value"]
    return (out + np.triu(out, 1).T) / n


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """Largest components of the vectors' covariance; none where nothing varies."""
    lengths = vectors.agg(F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most")).first()
    if not lengths["most"]:
        return None
    if lengths["least"] != lengths["most"]:
        raise ValueError("vectors of different lengths span no common space")
    if lengths["most"] > MAX_DIMENSIONS:
        raise ValueError(f"more than {MAX_DIMENSIONS} dimensions")
    n, sums = exact_sums(vectors)
    values, axes = np.linalg.eigh(covariance(vectors, n, sums))
    values, axes = values[::-1], axes[:, ::-1]
    kept = min(components, int((values > FLAT * len(values) * max(values[0], 0)).sum()))
    if not kept:
        return None
    axes = axes[:, :kept]
    # Either sign is right; the largest entry is made positive, so that runs agree.
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), range(kept)])
    return Fit(n, tuple(sums), axes, values[:kept], float(values.sum()))


def whitened(vectors: DataFrame, f: Fit) -> DataFrame:
    """``key, weight, deviation, z`` of each distinct vector, written."""
    n, sums, axes = f.n, f.sums, f.axes / np.sqrt(f.values)

    def run(batches):
        import pyarrow as pa

        for b in pieces(batches):
            x = matrix(b.column("x"))
            most = float(np.abs(x.astype(float)).max(initial=0)) * n + float(max(map(abs, sums), default=0))
            wide = most * most * len(sums) >= 2**62
            d = (x.astype(object) if wide else x) * n - np.array(sums, dtype=object if wide else np.int64)
            deviation = [Decimal(int(v)) if abs(int(v)) < 10**38 else None for v in (d * d).sum(axis=1)]
            z = centred(x, n, sums) @ axes
            yield pa.RecordBatch.from_arrays(
                [b.column("key"), b.column("weight"), pa.array(deviation, pa.decimal128(38, 0)), pa.array(z.tolist(), pa.list_(pa.float64()))],
                ["key", "weight", "deviation", "z"],
            )

    schema = "key binary, weight bigint, deviation decimal(38,0), z array<double>"
    return materialize(vectors.select("key", "weight", "x").mapInArrow(run, schema), "whitened-vectors")


def identity_error(vectors: DataFrame, n: int, components: int) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity."""
    z, w = [F.get("z", F.lit(i)) for i in range(components)], F.col("weight")
    means = vectors.agg(*[(F.sum(w * c) / n).alias(f"m{i}") for i, c in enumerate(z)]).first()
    off = [c - F.lit(float(m)) for c, m in zip(z, means, strict=True)]
    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    found = vectors.agg(*[(F.sum(w * off[i] * off[j]) / n).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(c - (i == j)) for c, (i, j) in zip(found, pairs, strict=True))


def whiten(
    embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, weights: str = "counts"
) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of every usable row and component.

    ``n`` is the fit's weight: all usable rows with ``weights="counts"``, all distinct vectors with ``"one"``.  Null and
    non-finite vectors are left out; null and repeated ids and equal vectors are rows like others.  Components in which
    nothing varies (fewer directions than ``components``, one vector only, empty vectors, an empty table) have no rows.
    ``deviation`` is exact, null if it has more than 38 digits.  Vectors of different lengths are an error.
    """
    if weights not in ("counts", "one"):
        raise ValueError("weights are counts or one")
    rows = embeddings.filter(usable(vector_col)).select(F.col(id_col).cast("long").alias("vec_id"), on_grid(vector_col).alias("x"))
    vectors = distinct_vectors(rows, weights)
    f = fit(vectors, components)
    if f is None:
        return embeddings.sparkSession.createDataFrame(
            [], "vec_id bigint, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
        )
    found = whitened(vectors, f)
    error = identity_error(found, f.n, len(f.values))
    shares = F.array(*[F.lit(float(v / f.trace)) for v in f.values])
    back = rows.select("vec_id", digest("x").alias("key")).join(found.select("key", "deviation", "z"), "key")
    return back.select("vec_id", "deviation", F.posexplode("z").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(f.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )


@query("op11_embedding_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``deviation`` is null where a long cannot hold it."""
    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("bigint"))
