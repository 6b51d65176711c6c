"""Sharding by proportional stratified interleaving, in native operations only.

Within each source the rows stand in a seeded shuffle.  The row of rank ``r`` among the ``n`` of its source has the
fractional rank ``(r - 1 + u) / n``, ``u`` a seeded share of 0 to 1 per source, so that sources of few rows do not all
fall into the middle.  In the order of the fractional ranks every stretch holds the sources in the proportions of the
whole, and shards are equal stretches of it.

Both orders are taken by range exchange on keys that end in the row's own number, so a source with any share of the rows,
or one document repeated any number of times, is dealt over all tasks.  Only names, sizes and checksums are moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranks import positions
from .common import materialize, numbered, query, table, utf8

SHARDS, SEED = 24, 42

#: Hexadecimal digits of a hash that are taken as a number, and the number of values they have.
DIGITS = 15
SPAN = 1 << (4 * DIGITS)

#: Bytes that a row counts besides its text.
ROW_BYTES = 8


def seeded(seed: int, c: Column) -> Column:
    """A number of 60 bits from the seed and a value, null as empty."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(c.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, DIGITS), 16, 10).cast("long")


def sizes(rows: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``__row, doc_id, source, size, text_crc32`` of numbered rows: all that the operator moves."""
    return rows.select(
        "__row", F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        (F.octet_length(utf8(text_col)) + ROW_BYTES).cast("long").alias("size"), F.crc32(utf8(text_col)).alias("text_crc32"),
    )


def interleave(slim: DataFrame, seed: int = SEED) -> DataFrame:
    """``slim`` with ``rank`` in the source's shuffle, ``fraction`` and ``place``, the row's place among all.

    ``slim`` is a written table with ``__row, doc_id, source, size, text_crc32``.
    """
    shuffled = [F.col(c).asc_nulls_first() for c in ("source", "__key", "doc_id", "size", "text_crc32", "__row")]
    ordered = positions(slim.withColumn("__key", seeded(seed, F.col("doc_id"))), shuffled, "__at_source")
    strata = ordered.groupBy(F.col("source").alias("__source")).agg(F.min("__at_source").alias("__first"), F.count(F.lit(1)).alias("__n"))
    strata = strata.withColumn("__share", seeded(seed, F.col("__source")))
    ranked = ordered.join(strata, F.col("source").eqNullSafe(F.col("__source"))).withColumn("rank", F.col("__at_source") - F.col("__first"))
    fraction = (F.col("rank") + F.col("__share").cast("double") / F.lit(float(SPAN))) / F.col("__n")
    mixed = ranked.withColumn("fraction", fraction).drop("__source", "__key", "__at_source", "__first", "__n")
    return positions(mixed, [F.col(c).asc_nulls_first() for c in ("fraction", "__share", "source", "rank")], "place").drop("__share")


def assign(slim: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``slim`` with ``rank, fraction, place, shard, slot``: equal stretches of the interleaved order.

    Shards differ by one row at most; slots run from 0 without gaps.  With fewer rows than shards some shards are empty.
    """
    total = slim.count()
    shard = F.expr(f"place * {shards} div {max(total, 1)}")
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return interleave(slim, seed).withColumn("shard", shard.cast("int")).withColumn("slot", (F.col("place") - first).cast("long"))


def shard_plan(
    docs: DataFrame, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """One row per row of ``docs``: ``__row, doc_id, source, size, text_crc32, rank, fraction, place, shard, slot``.

    Null texts have no bytes; a null source is a source of its own; null and repeated ids are dealt like others, rows that
    agree in everything in any order.  An empty table gives an empty plan.  Other columns are not looked at.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    return assign(materialize(sizes(numbered(docs), id_col, text_col, source_col), "sizes"), shards, seed)


def sharded(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, **columns: str) -> DataFrame:
    """All columns of ``docs`` with ``shard`` and ``slot`` (which replace columns of these names)."""
    if "__row" in docs.columns:
        raise ValueError("__row is the operator's own column")
    rows = numbered(docs)
    names = {"id_col": "doc_id", "text_col": "text", "source_col": "source"} | columns
    plan = assign(materialize(sizes(rows, **names), "sizes"), shards, seed)
    return rows.drop("shard", "slot").join(plan.select("__row", "shard", "slot"), "__row").drop("__row")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, **columns: str) -> None:
    """Writes one folder per shard, each file's rows in the order of their slots."""
    out = sharded(docs, shards, seed, **columns)
    out.repartition("shard", F.expr("slot div 100000")).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def _sql() -> str:
    number = "('0x' || substr(md5(concat('{}:', coalesce(CAST({} AS VARCHAR), ''))), 1, {}))::BIGINT".format
    table_of = "list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
    crc = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(b), '..'), lambda h: ('0x' || h)::BIGINT)), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295::BIGINT)"
    return f"""WITH k AS (SELECT {table_of} AS tab), b AS (SELECT doc_id, source, encode(coalesce(text, '')) AS b FROM documents),
d AS (SELECT doc_id, source, octet_length(b) + {ROW_BYTES} AS size, {crc} AS crc FROM b, k),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {number(SEED, 'doc_id', DIGITS)}, doc_id NULLS FIRST, size, crc) - 1 AS r,
    count(*) OVER (PARTITION BY source) AS n, {number(SEED, 'source', DIGITS)} AS share FROM d),
p AS (SELECT *, row_number() OVER (ORDER BY (r + CAST(share AS DOUBLE) / {float(SPAN)!r}::DOUBLE) / n, share, source NULLS FIRST, r) - 1 AS place, count(*) OVER () AS total FROM r)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'rows' AS law, CAST(place * {SHARDS} // total AS INTEGER) AS shard,
    CAST(place - ((place * {SHARDS} // total) * total + {SHARDS - 1}) // {SHARDS} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM p"""


@query("op12_sharding", _sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = shard_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
