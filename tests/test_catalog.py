"""Every registered query runs; every one with reference SQL returns the same rows as DuckDB."""

from __future__ import annotations

import pytest
from compare import differences, oracle_rows, spark_rows

from panelwright.catalog import ORACLES, QUERIES


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck, sf_dir):
    got = spark_rows(QUERIES[name](spark, sf_dir))
    if name in ORACLES:
        assert differences(got, oracle_rows(duck, ORACLES[name])) is None
        if name != "T1_headline_filter_shipped":
            assert got[0], "a query without rows checks nothing"
