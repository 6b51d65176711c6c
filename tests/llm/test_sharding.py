from __future__ import annotations

import re
import zlib
from collections import Counter
from hashlib import md5

import pytest
from cases import TEXTS

from panelwright.llm.sharding import SEED, SPAN, shard_plan, sharded, write_shards

SCHEMA = "doc_id bigint, text string, source string"
SOURCES = ["web", None, "code", "books", "web", "web", "", "web", "news", "web", "web"]
ROWS = [(i, t, SOURCES[k]) for k, (i, t) in enumerate(TEXTS)]


def number(value) -> int:
    return int(md5(f"{SEED}:{'' if value is None else value}".encode()).hexdigest()[:15], 16)


def first(value):
    return (value is not None, value if value is not None else 0)


def slow(rows, shards: int):
    slim = [(i, s, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, s in rows]
    mixed = []
    for source in {s for _, s, _, _ in slim}:
        own = sorted((x for x in slim if x[1] == source), key=lambda x: (number(x[0]), first(x[0]), x[2], x[3]))
        share = number(source)
        mixed += [((r + float(share) / float(SPAN)) / len(own), share, (source is not None, source or ""), r, x) for r, x in enumerate(own)]
    mixed.sort(key=lambda m: m[:4])
    out, n = [], len(mixed)
    for place, (*_, (i, _, size, crc)) in enumerate(mixed):
        shard = place * shards // n
        out.append((i, size, crc, shard, place - -(-shard * n // shards)))
    return sorted(out, key=repr)


def plan_rows(df, shards):
    return sorted(((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in shard_plan(df, shards).collect()), key=repr)


@pytest.mark.parametrize("shards", [1, 3, 24])
def test_against_brute_force(table_of, shards):
    assert plan_rows(table_of(ROWS, SCHEMA), shards) == slow(ROWS, shards)


def test_empty_table(table_of):
    assert shard_plan(table_of([], SCHEMA)).collect() == []
    with pytest.raises(ValueError):
        shard_plan(table_of([], SCHEMA), 0)


def test_one_document_in_most_rows(table_of):
    """Rows that agree in everything get slots of their own."""
    rows = [(None, "same", "web")] * 300 + [(i, f"text {i}", "rare") for i in range(60)]
    assert plan_rows(table_of(rows, SCHEMA), 7) == slow(rows, 7)


def test_every_shard_has_the_mixture(spark):
    sources = ["a"] * 3000 + ["b"] * 900 + ["c"] * 100 + [f"s{i}" for i in range(200)]
    df = spark.createDataFrame([(i, "x" * (i % 50), s) for i, s in enumerate(sources)], SCHEMA)
    got = shard_plan(df, 12).collect()
    per_shard = Counter(r.shard for r in got)
    assert max(per_shard.values()) - min(per_shard.values()) <= 1
    for shard, n in per_shard.items():
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(n))
    for source, most in (("a", 3000), ("b", 900), ("c", 100)):
        held = Counter(r.shard for r in got if r.source == source)
        # Off by the rounding of every source that stands before the cut, not by a share.
        assert all(abs(held[k] - most / 12) <= 12 for k in range(12)), held
    rare = Counter(r.shard for r in got if r.source.startswith("s"))
    assert max(rare.values()) <= 40 and len(rare) == 12


def test_whole_rows_keep_their_columns(table_of, tmp_path):
    df = table_of(ROWS, SCHEMA).selectExpr("*", "7 AS shard", "'x' AS place", "'y' AS rank")
    out = sharded(df, 3)
    assert out.columns == [c for c in df.columns if c != "shard"] + ["shard", "slot"]
    assert sorted(((r.doc_id, r.text, r.source) for r in out.collect()), key=repr) == sorted(ROWS, key=repr)
    write_shards(df, str(tmp_path / "out"), 3)
    back = df.sparkSession.read.parquet(str(tmp_path / "out"))
    assert sorted((r.shard, r.slot) for r in back.collect()) == sorted((r.shard, r.slot) for r in out.collect())


def test_seed_moves_rows(table_of):
    df = table_of(ROWS, SCHEMA)
    assert {(r.doc_id, r.place) for r in shard_plan(df, 3, seed=1).collect()} != {(r.doc_id, r.place) for r in shard_plan(df, 3).collect()}


def test_plan_is_native(table_of):
    plan = shard_plan(table_of(ROWS, SCHEMA))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
