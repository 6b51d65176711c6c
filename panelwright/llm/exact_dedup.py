"""Exact dedup by content-defined chunk recipes.

Every text is cut where a rolling hash of its last bytes says so.  Chunk bytes move once, to verify that chunks under
one identifier are the same bytes; if two are not, a stronger identifier takes its place and is verified again.  From
then on a text is the ordered list of its chunk identifiers, and only those lists are grouped and joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed, materialize, per_batch, query, table, utf8

#: Chunk sizes in bytes: none below MIN (but the last), none above MAX, about MIN + 2 ** MEAN_BITS on average.
MIN_CHUNK, MEAN_BITS, MAX_CHUNK = 512, 10, 16_384


def gear_table():
    """256 pseudo-random 32-bit numbers, one per byte value."""
    import numpy as np

    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return ((x * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)).astype(np.uint32)


def chunk_ends(text: bytes, gear, low: int = MIN_CHUNK, bits: int = MEAN_BITS, high: int = MAX_CHUNK) -> list[int]:
    """Ends of the chunks of ``text``; an empty text has none.  A cut depends on the 16 bytes before it and on the
    cut before, so equal texts are cut alike and equal passages soon are."""
    import numpy as np

    n = len(text)
    if n <= low:
        return [n] if n else []
    h = gear[np.frombuffer(text, np.uint8)]
    for step in (1, 2, 4, 8):
        longer = h.copy()
        longer[step:] += h[:-step] << np.uint32(step)
        h = longer
    ends, last = [], 0
    for cut in (np.flatnonzero((h >> np.uint32(4)) & np.uint32((1 << bits) - 1) == 0) + 1).tolist():
        while cut - last > high:
            last += high
            ends.append(last)
        if cut - last >= low:
            ends.append(cut)
            last = cut
    while n - last > high:
        last += high
        ends.append(last)
    return [*ends, n] if n > last else ends


def fast_id(chunk: bytes) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(chunk)


def strong_id(chunk: bytes) -> bytes:
    from hashlib import sha256

    return sha256(chunk).digest()


#: Tried in turn until one is verified to name no two chunks alike.
CHUNK_IDS = (fast_id, strong_id)


def cut(text: bytes, gear) -> list[bytes]:
    ends = chunk_ends(text, gear)
    return [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def chunk_table(docs: DataFrame, name) -> DataFrame:
    """``h, chunk``: the chunks of column ``text`` under ``name(chunk)``; a chunk that repeats within a batch comes once."""

    def run(batch):
        gear = gear_table()
        seen = list({c for text in batch.column("text").to_pylist() for c in cut(text, gear)})
        return {"h": [name(c) for c in seen], "chunk": seen}

    return per_batch(run, "h binary, chunk binary", docs.select("text"))


def recipe_table(docs: DataFrame, name) -> DataFrame:
    """``id, sha, recipe``: SHA-256 of every text and its chunk identifiers in order, as one binary."""
    from hashlib import sha256

    def run(batch):
        gear, texts = gear_table(), batch.column("text").to_pylist()
        return {
            "id": batch.column("id"), "sha": [sha256(t).hexdigest() for t in texts],
            "recipe": [b"".join(map(name, cut(t, gear))) for t in texts],
        }

    return per_batch(run, "id bigint, sha string, recipe binary", docs)


def verified_id(docs: DataFrame, names=CHUNK_IDS):
    """The first of ``names`` under which all chunks with one identifier are the same bytes.

    The bytes are compared in one aggregation that keeps the smallest and the largest chunk of each identifier, so
    a chunk moves at most once per task however often it occurs.
    """
    for name in names:
        found = chunk_table(docs, name).groupBy("h").agg(F.min("chunk").alias("lo"), F.max("chunk").alias("hi"))
        if found.filter(F.col("lo") != F.col("hi")).isEmpty():
            return name
    raise ValueError("two different chunks have the same identifier under every hash")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", names=CHUNK_IDS) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row of ``docs``.

    Null texts count as empty; of equal texts the row with the largest id stays (a null id is smaller than any), and
    of repeated rows with that id exactly one; an empty table gives an empty result.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("text"))
    recipes = keyed(recipe_table(texts, verified_id(texts, names)), "recipes")
    groups = recipes.groupBy("recipe").agg(F.max(F.struct("id", "__row")).alias("__keep"), F.count(F.lit(1)).alias("group_size"))
    # Written, so that the join below deals both sides anew and splits the rows of a large group.
    groups = materialize(groups.filter("group_size > 1"), "recipe-groups")
    out = recipes.join(groups, "recipe", "left")
    keep = F.coalesce("__keep", F.struct("id", "__row"))
    return out.select(
        F.col("id").alias("doc_id"), keep["id"].alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"),
        (keep["__row"] == F.col("__row")).alias("kept"), F.col("sha").alias("text_sha256"),
    )


@query("op3_exact_dedup", """SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
    count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
    doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept, sha256(coalesce(text, '')) AS text_sha256 FROM documents""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))
