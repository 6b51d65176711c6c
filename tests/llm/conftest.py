from __future__ import annotations

import pytest
from cases import TEXTS
from pyspark.sql import Row


@pytest.fixture
def table_of(spark):
    """A table from rows, with extra columns whose names clash with those that operators use inside."""

    def make(rows, schema, clash: bool = True):
        names = [x.split()[0] for x in schema.split(", ")]
        df = spark.createDataFrame([Row(**dict(zip(names, r, strict=True))) for r in rows], schema) if rows else spark.createDataFrame([], schema)
        return df.selectExpr("*", "'x' AS h", "1 AS n", "2 AS fp", "'y' AS key", "3 AS id", "true AS kept", "'z' AS word") if clash else df

    return make


@pytest.fixture
def texts(table_of):
    return table_of(TEXTS, "doc_id bigint, text string")


@pytest.fixture
def no_texts(table_of):
    return table_of([], "doc_id bigint, text string")
