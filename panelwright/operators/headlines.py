"""Headline filtering, lexicon sentiment and deduplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .panel import keep_by_max

# Keyword and lexicon lists.
KEYWORDS = (
    "gold", "silver", "miner", "gdx", "bullion", "precious metal",
    "fed", "federal reserve", "rate", "inflation", "dollar", "usd",
    "iran", "geopolit", "conflict", "war", "sanction",
    "china", "treasury", "yield", "vix", "risk",
)
BULLISH = ("rise", "rally", "surge", "gain", "high", "bull", "support", "strong", "jump", "up")
BEARISH = ("fall", "drop", "slump", "decline", "low", "bear", "weak", "slide", "down", "sell")


def _hits(text: Column, words: Sequence[str]) -> Column:
    total = F.lit(0)
    for word in words:
        total = total + text.contains(word).cast("int")
    return total


def headline_filter(df: DataFrame, keywords: Sequence[str] = KEYWORDS, since=None, title="title", date="date") -> DataFrame:
    """Titles holding any keyword, on or after a cutoff date or column."""
    out = df.filter(_hits(F.lower(F.col(title)), keywords) > 0)
    if since is None:
        return out
    return out.filter(F.col(date) >= (since if isinstance(since, Column) else F.to_timestamp(F.lit(since))))


def headline_sentiment(df: DataFrame, bullish=BULLISH, bearish=BEARISH, title: str = "title") -> DataFrame:
    """Sign of bullish less bearish words present, by substring."""
    text = F.lower(F.col(title))
    up, down = _hits(text, bullish), _hits(text, bearish)
    return df.withColumns(
        {
            "n_bullish": up, "n_bearish": down,
            "sentiment": F.when(up > down, "up").when(down > up, "down").otherwise("neutral"),
        }
    )


def headline_dedup(
    df: DataFrame, top: int | None = 20, title: str = "title", date: str = "date", tiebreak: Sequence[str] = ("url",),
    key_chars: int | None = None,
) -> DataFrame:
    """Newest title per lower-case text, then the newest ``top``.

    ``key_chars`` compares the first characters only.

    The key is aggregated map-side, so a title copied into a third of all rows is one row per task
    before the shuffle; the report's head is a distributed top-k.
    """
    keyed = df.withColumn("title_key", F.lower(F.col(title) if key_chars is None else F.substring(title, 1, key_chars)))
    kept = keep_by_max(keyed, ["title_key"], [F.col(date), *[F.col(c) for c in tiebreak]])
    if top is None:
        return kept
    return kept.orderBy(F.desc(date), *[F.desc(c) for c in tiebreak]).limit(top)
