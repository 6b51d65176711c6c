"""Order-insensitive comparison of a Spark query with its reference SQL in DuckDB."""

from __future__ import annotations

import datetime as dt
import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.6f}"
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    if hasattr(v, "as_tuple"):
        return f"{float(v):.6f}"
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(_cell(row[i]) for i in order) for row in rows], key=repr), sorted(names)


def spark_rows(df):
    return _rows(df.columns, [tuple(x) for x in df.collect()])


def oracle_rows(con, sql):
    rel = con.sql(sql)
    return _rows(rel.columns, rel.fetchall())


def differences(spark_side, oracle_side, show: int = 5) -> str | None:
    (a, an), (b, bn) = spark_side, oracle_side
    if an != bn:
        return f"columns {an} != {bn}"
    if a == b:
        return None
    sa, sb = set(map(repr, a)), set(map(repr, b))
    only_a, only_b = sorted(sa - sb), sorted(sb - sa)
    return f"rows {len(a)} vs {len(b)}; only spark {len(only_a)}: {only_a[:show]}; only oracle {len(only_b)}: {only_b[:show]}"
