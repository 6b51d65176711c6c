from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from cases import TEXTS
from pyspark.sql import functions as F

from panelwright.llm.graph import components
from panelwright.llm.simhash_join import (
    allocate, fingerprint, forest, group_bits, jaccard_matrix, keep_one, near_groups, near_links, plan_partitions, shingle_hashes, within_bits,
)


def slow_fingerprint(text: str) -> int:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in low).split(" ") if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, linked):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in nodes}


def test_fingerprints():
    for _, t in TEXTS:
        assert fingerprint((t or "").encode()) % 2**64 == slow_fingerprint(t or "")


@pytest.mark.parametrize("large", [1, 4, 128])
def test_links_connect_what_lies_within_three_bits(spark, large):
    rng = random.Random(large)
    values = {0}
    for _ in range(60):
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 8])):
            values.add(x)
            for b in rng.sample(range(64), rng.randint(1, 5)):
                x ^= 1 << b
    signed = [v - 2**64 if v >> 63 else v for v in values]
    distinct = spark.createDataFrame([(v,) for v in signed], "fp bigint")
    plan = plan_partitions(distinct)
    assert sum(t + 1 for _, t in plan) == 4
    edges = [(r.a, r.b) for r in near_links(distinct, plan, large_bucket=large).collect()]
    near = [(a, b) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) % 2**64).bit_count() <= 3]
    assert roots(signed, edges) == roots(signed, near)


def test_groups(texts, no_texts, spark):
    rows = near_groups(texts).collect()
    fp = [(r.id, r.fp) for r in rows]
    assert len(rows) == len(TEXTS)
    want = {}
    classes = roots({f for _, f in fp}, [(a, b) for _, a in fp for _, b in fp if ((a ^ b) % 2**64).bit_count() <= 3])
    for i, f in fp:
        if i is not None:
            want[classes[f]] = min(i, want.get(classes[f], i))
    assert all(r.component == want.get(classes[r.fp]) for r in rows)
    assert near_groups(no_texts).collect() == []
    kept = keep_one(texts)
    assert kept.columns == texts.columns and kept.count() == len({(t or "").strip() for _, t in TEXTS})
    assert keep_one(no_texts).collect() == []


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 50)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(90)]
    got = {r.a: r.b for r in components(spark.createDataFrame([*edges, (7, 7), (0, 1)], "a bigint, b bigint")).collect()}
    want = roots({x for e in edges for x in e}, edges)
    assert {x: r for x, r in want.items() if x != r} == got
    assert components(spark.createDataFrame([], "a bigint, b bigint")).filter(F.col("a") > 0).collect() == []


def test_plan_parts():
    assert allocate([[0, 5, 9, 99], [0, 1, 2, 3]], 4) == (8.0, [0, 2])
    x = np.random.default_rng(0).integers(0, 2, (500, 64))
    x[:, 40] = x[:, 3]
    groups = group_bits((x.T @ x).astype(float), 500, 4)
    assert sorted(b for g in groups for b in g) == list(range(64))
    assert any({3, 40} <= set(g) for g in groups)


def test_forest_spans_components():
    rng = np.random.default_rng(2)
    base = rng.integers(-(2**62), 2**62, 5)
    v = np.unique(np.concatenate([base ^ (1 << int(b)) for b in rng.integers(0, 20, 12)]))
    edges = list(zip(*(x.tolist() for x in forest(v[::2], v[1::2], within_bits(v[::2], v[1::2], 3))), strict=True))
    near = [(a, b) for a in v[::2].tolist() for b in v[1::2].tolist() if ((a ^ b) % 2**64).bit_count() <= 3]
    assert roots(v.tolist(), edges) == roots(v.tolist(), near) and len(edges) < len(v)


def jaccard(a: str, b: str) -> float:
    x, y = (set(shingle_hashes(t.encode(), 5)) for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


@pytest.mark.parametrize("large", [2, 128])
def test_one_of_each_group_of_similar_texts_stays(spark, large):
    rng = random.Random(5)
    rows = []
    for _ in range(25):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(60, 300))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            own = list(words)
            for _ in range(rng.randint(0, max(1, len(own) // 60))):
                own[rng.randrange(len(own))] = "changed" + str(rng.randrange(99))
            rows.append((len(rows), " ".join(own)))
    kept = {r.doc_id for r in keep_one(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1), large_bucket=large).collect()}
    near = [(i, j) for i, a in rows for j, b in rows[:i] if jaccard(a, b) >= 0.8]
    want = {i for i, r in roots([i for i, _ in rows], near).items() if i == r}
    assert kept == want and len(want) < len(rows)


def test_jaccard_matrix(monkeypatch):
    from panelwright.llm import simhash_join

    monkeypatch.setattr(simhash_join, "COLUMNS", 3)
    rng = np.random.default_rng(1)
    left, right = ([np.unique(rng.integers(0, 12, rng.integers(0, 8))) for _ in range(n)] for n in (5, 7))
    want = [[len(set(a) & set(b)) / len(set(a) | set(b)) if len(a) + len(b) else 1.0 for b in right] for a in left]
    assert np.allclose(jaccard_matrix(left, right), want)


@pytest.mark.parametrize("often", [0, 30])
def test_similar_sets_share_a_prefix(often):
    """Every pair with the similarity shares a shingle of its prefixes, whichever shingles come last in the order."""
    from panelwright.llm.simhash_join import JACCARD, prefix

    rng = np.random.default_rng(often)
    common = np.sort(rng.choice(90, often, replace=False))
    found = 0
    for _ in range(3000):
        a = rng.choice(90, rng.integers(1, 40), replace=False)
        b = np.union1d(rng.choice(a, max(1, len(a) - rng.integers(0, 5)), replace=False), rng.choice(90, rng.integers(0, 4)))
        if len(np.intersect1d(a, b)) >= JACCARD * len(np.union1d(a, b)):
            found += 1
            assert set(prefix(a.tolist(), common).tolist()) & set(prefix(b.tolist(), common).tolist())
    assert found > 500 and len(prefix([], common)) == 0


def test_unlike_texts_share_no_keys(spark):
    """The rows that near duplicates are looked for by go with the texts and the pairs that are alike, not with the number of texts squared."""
    from panelwright.llm.common import keyed
    from panelwright.llm.simhash_join import _distinct, prefixed_prints, shared_keys

    rng = random.Random(8)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(100))
    docs = keyed(spark.createDataFrame([(i, text()) for i in range(400)], "doc_id bigint, text string"), "unlike")
    prints = prefixed_prints(docs, "text")
    assert prints.selectExpr("max(size(keys)) AS n").first().n == 96 - 77 + 1
    assert shared_keys(prints, _distinct(prints)).isEmpty()


def test_a_crowd_of_near_copies_is_one_group(spark, monkeypatch):
    from panelwright.llm import simhash_join

    monkeypatch.setattr(simhash_join, "SHARED", 1)
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    rows = [(i, " ".join([*words[:i], f"changed{i}", *words[i + 1 :]])) for i in range(40)] + [(40, " ".join(words[::-1]))]
    kept = keep_one(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1), large_bucket=4).collect()
    assert {r.doc_id for r in kept} == {0, 40}


def test_counted_shingles_set_the_order_only(spark, monkeypatch):
    """The same rows stay whether shingles are counted in all texts, in a 16th of them or in none; some buckets are large."""
    from panelwright.llm import simhash_join as sj

    rng = random.Random(6)
    often = [" ".join(rng.choice("abcdefgh") + str(rng.randint(0, 99)) for _ in range(12)) for _ in range(3)]
    texts = []
    for _ in range(60):
        words = [f"w{rng.randint(0, 9999)}" for _ in range(60)]
        for _ in range(rng.randint(1, 5)):
            own = list(words)
            for _ in range(rng.randint(0, 2)):
                own[rng.randrange(60)] = f"x{rng.randint(0, 9999)}"
            texts.append(" ".join([rng.choice(often), *own, rng.choice(often)]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    none = lambda docs, text_col, most=0: np.zeros(0, np.int64)
    found = []
    for of, fn in ((1, sj.common_shingles), (16, sj.common_shingles), (1, none)):
        monkeypatch.setattr(sj, "COMMON_OF", of)
        monkeypatch.setattr(sj, "common_shingles", fn)
        found.append({r.doc_id for r in keep_one(docs, large_bucket=2).collect()})
        monkeypatch.undo()
    assert found[0] == found[1] == found[2] and 60 <= len(found[0]) < len(texts)
