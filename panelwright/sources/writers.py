"""Sinks (S8-S11)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_predictions(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Partitioned by strategy, so that a reader of one strategy lists only its files."""
    df.write.mode(mode).partitionBy("strategy").parquet(path)


def ledger_file(led: DataFrame, keys: Sequence[str] = ("strategy", "symbol")) -> DataFrame:
    """Export form of a ledger: capital split into stock and cash."""
    cap, pos = F.col("capital"), F.col("position")
    return led.select(
        *keys, "date", F.round(cap, 2).alias("portfolio"), pos.alias("position"),
        F.round(cap * pos, 2).alias("stock"), F.round(cap * (1 - pos), 2).alias("cash"),
    )


def write_ledger(led: DataFrame, path: str, keys: Sequence[str] = ("strategy", "symbol"), mode: str = "overwrite") -> None:
    ledger_file(led, keys).write.mode(mode).parquet(path)


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.round(c, digits) for c in doubles})


def write_table(df: DataFrame, path: str, digits: int = 4, mode: str = "overwrite") -> None:
    """CSV with a header and doubles rounded: trade, stop, sweep, screen and importance tables."""
    flat = df.select(*[c for c in df.columns if not isinstance(df.schema[c].dataType, (T.ArrayType, T.StructType, T.MapType))])
    rounded(flat, digits).write.mode(mode).option("header", True).csv(path)


LOG_COLUMNS = {
    "symbol": "string", "date": "date", "direction": "string", "ensemble": "double", "pct_ret": "double",
    "agreement": "double", "n_folds": "bigint", "action": "string", "position": "double", "conf_pct": "double",
    "realised_vol": "double", "outcome_actual": "double", "outcome_correct": "boolean",
}


def log_rows(df: DataFrame) -> DataFrame:
    """Signals in the log's schema; absent columns, the outcomes above all, start as NULL."""
    have = set(df.columns)
    return df.select(*[(F.col(c).cast(t) if c in have else F.lit(None).cast(t)).alias(c) for c, t in LOG_COLUMNS.items()])


def append_signal(df: DataFrame, path: str) -> None:
    """Adds rows to the signal log."""
    log_rows(df).write.mode("append").parquet(path)
