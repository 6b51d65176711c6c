from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pytest

from panelwright.llm.catalog import QUERIES
from panelwright.llm.whitening import whiten

SCHEMA = "vec_id bigint, embedding array<float>"


def grid(v):
    return tuple(math.floor(1024 * float(np.float32(c))) + 100_000 for c in v)


def good(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def slow(rows, components=8, once=False):
    """Exact sums and deviations, an explicit covariance, row by row."""
    kept = [(i, grid(v)) for i, v in rows if good(v)]
    base = sorted({x for _, x in kept}) if once else [x for _, x in kept]
    n, sums = len(base), [sum(c) for c in zip(*base, strict=True)]
    mean = [s / n for s in sums]
    off = np.array([[c - m for c, m in zip(x, mean, strict=True)] for x in base])
    values, axes = np.linalg.eigh(off.T @ off / n)
    values, axes = values[::-1], axes[:, ::-1]
    out = []
    for i, x in kept:
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))
        here = np.array([c - m for c, m in zip(x, mean, strict=True)])
        for k in range(min(components, int((values > 1e-9 * values[0]).sum()))):
            out.append((i, k + 1, n, deviation, float(here @ axes[:, k] / math.sqrt(values[k])), values[k] / values.sum()))
    return out


def check(got, want):
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[3], abs(r[4]))
    got = sorted(((r.vec_id, r.component, r.n, int(r.deviation), r.whitened, r.explained) for r in got), key=key)
    want = sorted(want, key=key)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    signs = defaultdict(set)
    for a, b in zip(got, want, strict=True):
        assert abs(abs(a[4]) - abs(b[4])) < 1e-7 * (1 + abs(b[4])) and abs(a[5] - b[5]) < 1e-6 * b[5]
        if abs(b[4]) > 1e-6:
            signs[a[1]].add(a[4] * b[4] > 0)
    assert all(len(s) == 1 for s in signs.values())


def made(n=300, size=12, seed=3):
    rng = np.random.default_rng(seed)
    base = (rng.normal(size=(n, size)) * np.linspace(1, 0.1, size)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(1000 + i, base[0].tolist()) for i in range(n)] + [(5, base[1].tolist()), (None, base[2].tolist())]
    rows += [(2001, None), (2002, [None] + [0.0] * (size - 1)), (2003, [float("nan")] * size), (2004, [float("inf")] + [0.0] * (size - 1))]
    return rows


@pytest.mark.parametrize("weights", ["counts", "one"])
def test_against_brute_force(table_of, weights):
    got = whiten(table_of(made(), SCHEMA), weights=weights).collect()
    check(got, slow(made(), once=weights == "one"))
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-8


def test_query(spark, duck, sf_dir):
    rows = duck.sql("SELECT vec_id, embedding FROM embeddings").fetchall()
    got = QUERIES["op11_embedding_whitening"](spark, sf_dir).collect()
    check(got, slow(rows))
    assert got[0].identity_error <= 1e-4


def test_nothing_varies(table_of):
    for rows in ([], [(1, None)], [(1, [0.5, 0.25])], [(1, [])], [(i, [0.5, 0.25]) for i in range(9)]):
        assert whiten(table_of(rows, SCHEMA)).collect() == []


def test_fewer_directions_than_components(table_of):
    rows = [(i, [float(i), 2.0 * i, 0.5]) for i in range(20)]
    got = whiten(table_of(rows, SCHEMA)).collect()
    assert {r.component for r in got} == {1}
    check(got, slow(rows))


def test_far_entries_stay_exact(table_of):
    rows = [(i, [float(2**40 * (i % 7)), float(i % 3), -1e12 * i]) for i in range(40)]
    got = whiten(table_of(rows, SCHEMA)).collect()
    want = {r[0]: r[3] for r in slow(rows)}
    assert {r.vec_id: int(r.deviation) for r in got} == want and max(want.values()) > 2**63
    assert whiten(table_of([(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [0.0, 3.0])], SCHEMA)).count() > 0


def test_lengths_must_agree(table_of):
    with pytest.raises(ValueError):
        whiten(table_of([(1, [1.0]), (2, [1.0, 2.0])], SCHEMA))
