"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Most files whose names are sent along to number rows, and the bits that are left for a row's place in its file.
MAX_FILES, FILE_BITS = 100_000, 40

#: Rows that a function over texts handles at a time, and bytes of a batch that it does so at a time, by the batch's mean.
ROWS, SLICE_BYTES = 2048, 1 << 21

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name, with its DuckDB SQL where there is one."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(text: str) -> Column:
    """A text column as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def sliced(batches, rows: int = ROWS):
    """Batches of at most ``rows`` rows and, by their mean size, ``SLICE_BYTES``; what Arrow holds unused goes back at the end."""
    import pyarrow as pa

    for b in batches:
        most = max(1, min(rows, b.num_rows * SLICE_BYTES // max(b.nbytes, 1)))
        for a in range(0, max(b.num_rows, 1), most):
            yield b.slice(a, most)
    pa.default_memory_pool().release_unused()


def per_batch(fn: Callable, schema: str, df: DataFrame, rows: int = ROWS) -> DataFrame:
    """Maps each Arrow batch to a dict of columns; ``fn(batch) -> dict`` sees bounded batches, never a group.

    ``rows`` cuts batches further, so that few texts at a time are Python objects.

    Spark cuts batches by rows and by bytes (``spark.sql.execution.arrow.maxBytesPerBatch``), so memory is bounded
    by the batch and by the longest single text.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in sliced(batches, rows):
            out = fn(batch)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def keyed(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a unique ``__row``, written to the shared folder and read back, so that the numbers stay as
    they are when an executor is lost."""
    return materialize(df.withColumn("__row", F.monotonically_increasing_id()), name)


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with a unique ``__row`` that is the same whenever the table is read again.

    Rows of files are numbered by file and place: files are few, so their ranks by name go with the query, a table of
    two columns.  Anything else is written first.
    """
    try:
        files = df.select(F.col("_metadata.file_path").alias("__path"), F.col("_metadata.row_index").alias("__at"), "*")
    except AnalysisException:
        return keyed(df, "numbered")
    paths = sorted(files.select("__path").distinct().toPandas()["__path"])
    if len(paths) > MAX_FILES:
        return keyed(df, "numbered")
    ranks = df.sparkSession.createDataFrame([(p, i << FILE_BITS) for i, p in enumerate(paths)], "__path string, __first bigint")
    rows = files.join(F.broadcast(ranks), "__path", "left")
    return rows.select(*df.columns, (F.col("__first") + F.col("__at")).alias("__row"))


__all__ = ["ORACLES", "QUERIES", "ascii_lower", "keyed", "materialize", "numbered", "per_batch", "query", "sliced", "table", "utf8"]
