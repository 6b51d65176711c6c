"""Readers of landed files.

Each reader is a thin projection over ``spark.read``: explicit schemas, header aliases as a ``coalesce`` of
the spellings present, numeric text through ``try_cast``.  Filters and column choices stay visible to
Catalyst and reach the Parquet scan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import as_list, whole
from ..functions.indicators import positioning
from ..operators.panel import dedup_max, normalize_dates, text_match

PRICE_SCHEMA = "symbol string, date timestamp, close double, volume double"
BAR_SCHEMA = "symbol string, date timestamp, open double, high double, low double, close double, volume double"
PREDICTION_SCHEMA = "strategy string, symbol string, date timestamp, pred double, actual double, is_oof boolean"

# Header spellings of the positioning reports.
POSITION_ALIASES = {
    "spec_long": ("Noncommercial Positions-Long (All)", "NonComm_Positions_Long_All", "Noncommercial Long"),
    "spec_short": ("Noncommercial Positions-Short (All)", "NonComm_Positions_Short_All", "Noncommercial Short"),
    "comm_long": ("Commercial Positions-Long (All)", "Comm_Positions_Long_All", "Commercial Long"),
    "comm_short": ("Commercial Positions-Short (All)", "Comm_Positions_Short_All", "Commercial Short"),
    "open_int": ("Open Interest (All)", "Open_Interest_All", "Open Interest"),
}
POSITION_NAME, POSITION_CODE = "Market and Exchange Names", "CFTC Contract Market Code"
ISO_DATE, SHORT_DATE = "As of Date in Form YYYY-MM-DD", "As of Date in Form YYMMDD"

# Header spellings of the geopolitical-risk series.
MACRO_ALIASES = {"GPR": ("GPR", "GPRD"), "GPRACT": ("GPRACT", "GPRD_ACT"), "GPRTHR": ("GPRTHR", "GPRD_THREAT")}

# Name parts that mark the holdings column.
HOLDING_PARTS = ("tonn", "oz", "holding", "tonne")


def load(spark: SparkSession, path: str | Sequence[str], schema: str) -> DataFrame:
    """Parquet, and CSV with a header for those paths that say so."""
    csv = [p for p in as_list(path) if p.rstrip("/").endswith(".csv")]
    parquet = [p for p in as_list(path) if p not in csv]
    parts = ([spark.read.csv(csv, schema=schema, header=True)] if csv else []) + ([spark.read.schema(schema).parquet(*parquet)] if parquet else [])
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def clean_prices(df: DataFrame, min_rows: int = 0) -> DataFrame:
    """Positive closes, newest row per symbol and day, symbols with enough rows."""
    df = normalize_dates(df.filter(F.col("close") > 0), "date")
    if not min_rows:
        return df
    return df.withColumn("__n", F.count(F.lit(1)).over(whole("symbol"))).filter(F.col("__n") >= min_rows).drop("__n")


def read_prices(spark: SparkSession, path, min_rows: int = 200, start=None, end=None) -> DataFrame:
    return clean_prices(time_slice(load(spark, path, PRICE_SCHEMA), start, end), min_rows)


def read_bars(spark: SparkSession, path, start=None, end=None) -> DataFrame:
    """Daily bars, newest row per symbol and day."""
    return normalize_dates(time_slice(load(spark, path, BAR_SCHEMA), start, end).filter("close > 0"), "date")


def time_slice(df: DataFrame, start=None, end=None, date: str = "date") -> DataFrame:
    """Date range as a plain comparison with the stored column, so that the scan can skip row groups."""
    if start is not None:
        df = df.filter(F.col(date) >= F.to_timestamp(F.lit(start)))
    if end is not None:
        df = df.filter(F.col(date) < F.date_add(F.to_date(F.lit(end)), 1).cast("timestamp"))
    return df


def aliased(df: DataFrame, aliases: Mapping[str, Sequence[str]], cast: str = "double") -> dict:
    """One column per wanted name from whichever spellings are present."""
    out = {}
    for name, spellings in aliases.items():
        found = [F.col(f"`{s}`") for s in spellings if s in df.columns]
        if found:
            out[name] = F.coalesce(*found).try_cast(cast)
    return out


def macro_long(df: DataFrame, aliases: Mapping[str, Sequence[str]] = MACRO_ALIASES, date: str = "date") -> DataFrame:
    """Wide daily series under any header spelling to ``series, date, value`` (S3)."""
    picked = aliased(df, aliases)
    wide = df.select(F.to_date(date).alias("date"), *[c.alias(n) for n, c in picked.items()])
    return wide.unpivot(["date"], list(picked), "series", "value").dropna("any").select("series", "date", "value")


def read_macro(spark: SparkSession, path, aliases=MACRO_ALIASES, date: str = "date") -> DataFrame:
    return macro_long(spark.read.csv(as_list(path), header=True), aliases, date)


def _fuzzy(columns: Sequence[str]) -> dict[str, tuple[str, ...]]:
    """Spellings not in the alias table, matched by the words in the header."""
    out: dict[str, list[str]] = {}
    for c in columns:
        low = c.lower()
        side = "long" if "long" in low else "short" if "short" in low else None
        if "noncommercial" in low and side:
            out.setdefault(f"spec_{side}", []).append(c)
        elif "commercial" in low and side:
            out.setdefault(f"comm_{side}", []).append(c)
        elif "open interest" in low and "all" in low:
            out.setdefault("open_int", []).append(c)
    return {k: tuple(v) for k, v in out.items()}


def report_date(df: DataFrame):
    """First date column present whose text parses: ISO, YYMMDD (zero-filled), ``report_date``, any ``*date*``."""
    iso = lambda c: F.to_date(F.try_to_timestamp(F.substring(F.col(f"`{c}`").cast("string"), 1, 10), F.lit("yyyy-MM-dd")))
    parsed = lambda c: F.to_date(F.try_to_timestamp(F.lpad(F.trim(F.col(f"`{c}`").cast("string")), 6, "0"), F.lit("yyMMdd")))
    # Two-digit years from 69 on belong to the last century.
    short = lambda c: F.when(F.year(parsed(c)) > 2068, F.add_months(parsed(c), -1200)).otherwise(parsed(c))
    parts = []
    if ISO_DATE in df.columns:
        parts.append(iso(ISO_DATE))
    if SHORT_DATE in df.columns:
        parts.append(short(SHORT_DATE))
    if "report_date" in df.columns:
        parts.append(iso("report_date"))
    if not parts:
        parts = [iso(c) for c in df.columns if "date" in c.lower()][:1]
    if not parts:
        raise ValueError("no date column")
    return F.coalesce(*parts)


def normalize_positions(
    df: DataFrame, market: str | None = None, name_contains: str | None = None, code_prefix: str | None = None
) -> DataFrame:
    """One yearly layout to ``market, report_date`` and the five numeric columns."""
    if name_contains is not None and POSITION_NAME in df.columns:
        df = df.filter(text_match(POSITION_NAME, contains=name_contains))
    elif code_prefix is not None and POSITION_CODE in df.columns:
        df = df.filter(text_match(POSITION_CODE, startswith=code_prefix))
    aliases = dict(POSITION_ALIASES)
    if not any(s in df.columns for s in aliases["spec_long"]):
        aliases = {**aliases, **_fuzzy(df.columns)}
    picked = aliased(df, aliases)
    missing = [c for c in ("spec_long", "spec_short", "comm_long", "comm_short") if c not in picked]
    if missing:
        raise ValueError(f"positioning columns not found: {missing}")
    picked.setdefault("open_int", F.lit(None).cast("double"))
    label = F.lit(market) if market is not None else F.trim(F.col(f"`{POSITION_NAME}`"))
    out = df.select(label.alias("market"), report_date(df).alias("report_date"), *[picked[n].alias(n) for n in POSITION_ALIASES])
    return out.filter(F.col("report_date").isNotNull())


def combine_positions(layouts: Sequence[DataFrame]) -> DataFrame:
    """Union of all years, the report with the largest open interest per market and day, derived columns."""
    out = layouts[0]
    for part in layouts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    ranked = out.withColumn("__oi", F.coalesce("open_int", F.lit(-1.0)))
    return positioning(dedup_max(ranked, ["market", "report_date"], "__oi").drop("__oi"))


def read_positions(
    spark: SparkSession, paths: Sequence[str], market: str | None = None, name_contains: str | None = None,
    code_prefix: str | None = None,
) -> DataFrame:
    """Yearly CSV files, each with its own header spelling."""
    parts = [
        normalize_positions(spark.read.csv(p, header=True), market, name_contains, code_prefix) for p in as_list(paths)
    ]
    return combine_positions(parts)


def pick_series(df: DataFrame, parts: Sequence[str] = HOLDING_PARTS, date: str | None = None) -> DataFrame:
    """``date, value`` from the first column whose name holds any part, else the first data column."""
    date = date or df.columns[0]
    data = [c for c in df.columns if c != date]
    value = next((c for c in data if any(p in c.lower() for p in parts)), data[0])
    return df.select(F.to_date(date).alias("date"), F.col(f"`{value}`").try_cast("double").alias("value")).dropna("any")


def with_fallback(primary: DataFrame, fallback: DataFrame, on: Sequence[str] = ("date",)) -> DataFrame:
    """Primary value where there is one, the fallback's elsewhere."""
    a = primary.select(*on, F.col("value").alias("__p"))
    b = fallback.select(*on, F.col("value").alias("__f"))
    return a.join(b, list(on), "full").select(*on, F.coalesce("__p", "__f").alias("value"))


def read_series(spark: SparkSession, path, parts=HOLDING_PARTS, fallback: DataFrame | None = None) -> DataFrame:
    series = pick_series(spark.read.csv(as_list(path), header=True), parts)
    return series if fallback is None else with_fallback(series, fallback)


def add_mean_series(df: DataFrame, name: str = "attention", by: str = "keyword") -> DataFrame:
    """The keyword series plus their mean per date as one more series."""
    mean = df.groupBy("date").agg(F.avg("value").alias("value")).withColumn(by, F.lit(name))
    return df.select(by, "date", "value").unionByName(mean.select(by, "date", "value"))


def read_interest(spark: SparkSession, path, name: str = "attention") -> DataFrame:
    wide = spark.read.csv(as_list(path), header=True)
    date = wide.columns[0]
    words = [c for c in wide.columns[1:] if c.lower() != "ispartial"]
    picked = wide.select(F.to_date(date).alias("date"), *[F.col(f"`{c}`").try_cast("double").alias(c) for c in words])
    return add_mean_series(picked.unpivot(["date"], words, "keyword", "value").dropna("any"), name)


def clean_predictions(df: DataFrame, date: str = "date") -> DataFrame:
    """Filled rows only, newest per strategy, symbol and day."""
    return normalize_dates(df.dropna("any", subset=["pred", "actual"]), date, ["strategy", "symbol"])


def read_predictions(spark: SparkSession, path) -> DataFrame:
    return clean_predictions(load(spark, path, PREDICTION_SCHEMA))
