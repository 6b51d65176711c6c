"""Result files written as text: candidate blocks and key=value files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Labels and name format of the candidate blocks.
LABELS = {
    "annual_return_pct": "Annual return",
    "sharpe": "Sharpe ratio",
    "max_drawdown_pct": "Max drawdown",
    "win_rate_pct": "Win rate",
    "long_days_pct": "Days long",
}
BENCH_LABELS = {"bh_annual_return_pct": r"B&H annual return", "bh_max_drawdown_pct": r"B&H max drawdown"}
TAG = r"fwd(\d+)_lb(\d+)_IC(-?[\d.]+)_DA(-?[\d.]+)_Sh(-?[\d.]+)_seed(\d+)"
SEPARATOR = "=" * 40
NUMBER = r"\s*:\s*([+-]?[\d.,]+)"


def _number(text: Column, pattern: str) -> Column:
    found = F.regexp_extract(text, pattern, 1)
    return F.when(found != "", F.regexp_replace(found, ",", "").try_cast("double"))


def parse_candidates(blocks: DataFrame, text: str = "value") -> DataFrame:
    """One row per block of ``Candidate: <tag>`` and labelled lines.

    A label's own number is the first on its line; further values glued to the line carry labels of their
    own (``B&H ...``) and, for the repeated labels, are the out-of-fold figures.
    """
    t = F.col(text)
    tag = F.regexp_extract(t, r"Candidate:\s*(\S+)", 1)
    rows = blocks.filter(tag != "").withColumn("candidate", tag)
    part = lambda i: F.regexp_extract("candidate", TAG, i)
    ints = {"fwd": 1, "lookback": 2, "seed": 6}
    reals = {"ic": 3, "dir_acc": 4, "tag_sharpe": 5}
    line = lambda label: F.regexp_extract(t, rf"(?m)^\s*({label}\s*:.*)$", 1)
    values = {n: _number(line(label), rf"^{label}{NUMBER}") for n, label in LABELS.items()}
    values |= {n: _number(t, rf"{label}{NUMBER}") for n, label in BENCH_LABELS.items()}
    values |= {
        "oof_annual_return_pct": _number(line("Annual return"), rf".+(?<!B&H )Annual return{NUMBER}"),
        "oof_max_drawdown_pct": _number(line("Max drawdown"), rf".+Max drawdown{NUMBER}"),
        "oof_win_rate_pct": _number(line("Win rate"), rf".+Win rate{NUMBER}"),
    }
    return rows.select(
        "candidate",
        *[F.when(part(i) != "", part(i).try_cast("int")).alias(n) for n, i in ints.items()],
        *[F.when(part(i) != "", part(i).try_cast("double")).alias(n) for n, i in reals.items()],
        *[c.alias(n) for n, c in values.items()],
    )


def read_candidates(spark: SparkSession, path) -> DataFrame:
    """Reads the file by separator line, so that a block is one row and large files split."""
    return parse_candidates(spark.read.text(path, lineSep=SEPARATOR)).withColumn("board", F.lit("all"))


def parse_kv(lines: DataFrame, keys: list[str], by: str = "file", text: str = "value") -> DataFrame:
    """``key=value`` lines to one row per file; the keys are given, so the pivot needs no extra pass; of a repeated key
    the largest value counts (S13)."""
    pair = F.split(F.trim(F.col(text)), "=", 2)
    kv = lines.filter(F.col(text).contains("=")).select(by, F.trim(pair[0]).alias("k"), F.trim(pair[1]).alias("v"))
    return kv.groupBy(by).pivot("k", keys).agg(F.max("v"))


def read_kv(spark: SparkSession, path, keys: list[str]) -> DataFrame:
    return parse_kv(spark.read.text(path).withColumn("file", F.input_file_name()), keys)
