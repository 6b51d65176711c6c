from __future__ import annotations

import random

import pytest

from panelwright.llm import line_dedup
from panelwright.llm.common import keyed
from panelwright.llm.line_dedup import digest, drop_lines, edit_links, line_classes, probe_starts, segment_keys, segments, signatures, within_edits


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def changed(rng, text: str, n: int) -> str:
    for _ in range(n):
        k = rng.randint(0, len(text))
        text = rng.choice([text[:k] + rng.choice("abé") + text[k:], text[:k] + text[k + 1 :], text[:k] + rng.choice("abc") + text[k + 1 :]])
    return text


@pytest.mark.parametrize("tau", [1, 2, 3])
def test_distances(tau, monkeypatch):
    monkeypatch.setattr(line_dedup, "CELLS", 500)
    rng = random.Random(tau)
    pairs = []
    for _ in range(800):
        a = "".join(rng.choice("abé") for _ in range(rng.randint(0, 40)))
        b = changed(rng, a, rng.randint(0, tau + 2))
        if abs(len(a) - len(b)) <= tau:
            pairs.append((a, b))
    got = within_edits([a for a, _ in pairs], [b for _, b in pairs], tau).tolist()
    assert got == [min(edits(a, b), tau + 1) for a, b in pairs]


@pytest.mark.parametrize("tau", [1, 2, 3])
def test_near_lines_share_a_key(tau):
    rng = random.Random(tau)
    for _ in range(300):
        a = "".join(rng.choice("ab🙂") for _ in range(rng.randint(tau + 1, 30)))
        b = changed(rng, a, tau)
        if len(b) <= tau:
            continue
        (i, ik), (p, pk) = segment_keys([a, b], False, tau), segment_keys([a, b], True, tau)
        x, y = signatures([a, b]).tolist()
        assert ((x ^ y) & 0xFFFFFFFF).bit_count() <= 2 * tau and ((x ^ y) % 2**64 >> 32).bit_count() <= 4 * tau
        keys = lambda n, k, who: {x for m, x in zip(n.tolist(), k.tolist(), strict=True) if m == who}
        assert keys(i, ik, 0) & keys(p, pk, 1) or keys(i, ik, 1) & keys(p, pk, 0)


def test_segments():
    for n in range(3, 40):
        own = segments(n)
        assert [a for a, _ in own] == [sum(s for _, s in own[:i]) for i in range(3)] and sum(s for _, s in own) == n
    assert sum(len(probe_starts(10, i, 0)) for i in range(3)) == 5


def corpus(rng):
    base = ["".join(rng.choice("abcdef ") for _ in range(rng.randint(20, 45))).strip() for _ in range(12)]
    docs = []
    for i in range(40):
        lines = [changed(rng, rng.choice(base), rng.choice([0, 0, 1, 2, 6])) for _ in range(rng.randint(0, 5))]
        docs.append((i, "\n".join(lines + ["short"] * (i % 2))))
    return [*docs, (None, None), (3, docs[3][1]), (3, docs[3][1])]


def test_links_and_classes(spark, monkeypatch):
    rng = random.Random(9)
    rows = corpus(rng)
    docs = keyed(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1), "test")
    got = line_classes(docs).collect()
    text = {r["__row"]: (r.doc_id, r.text) for r in docs.collect()}
    lines = {(row, i): x.strip() for row, (_, t) in text.items() for i, x in enumerate((t or "").split("\n")) if len(x.strip()) >= 24}
    assert {(r["__row"], r.line) for r in got} == set(lines)
    distinct = sorted(set(lines.values()))
    near = [(a, b) for k, a in enumerate(distinct) for b in distinct[:k] if edits(a, b) <= 2]
    root = {x: x for x in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in near:
        root[find(a)] = find(b)
    first = {}
    for (row, i), x in lines.items():
        doc = text[row][0]
        place = ((doc is not None, doc or 0), row, i)
        first[find(x)] = min(place, first.get(find(x), place))
    for r in got:
        x = lines[r["__row"], r.line]
        assert (r.first_row, r.first_line) == first[find(x)][1:]
        assert r.n_links == sum(x in p for p in near)
        assert r.kept == ((r["__row"], r.line) == first[find(x)][1:])
    named = {digest(x.encode()): x for x in distinct}
    raw = docs.selectExpr("cast(coalesce(text, '') as binary) as text")
    monkeypatch.setattr(line_dedup, "SENT_IDS", 0)
    assert {frozenset((named[bytes(r.a)], named[bytes(r.b)])) for r in edit_links(raw).collect()} == {frozenset(p) for p in near}


def test_dropped_lines(spark, texts, no_texts):
    rows = [(1, "a first line that is long enough\nshort"), (2, "short\na first line that is lonG enough"), (3, "a first line that is long enough"), (4, ""), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in drop_lines(docs).collect()}
    assert got == {1: rows[0][1], 2: "short", 4: "", 5: None}
    assert drop_lines(texts).columns == texts.columns
    assert drop_lines(no_texts).collect() == []


def test_lines_at_the_end_of_a_chain_stay(spark):
    """Rows that differ by two edits from the next one only: those two links away from a line that stays are no repeats."""
    chain = ["y" * (2 * i) + "x" * (30 - 2 * i) for i in range(6)]
    docs = spark.createDataFrame(list(enumerate(chain)), "doc_id bigint, text string")
    assert {r.doc_id for r in drop_lines(docs).collect()} == {0, 2, 4}


@pytest.mark.parametrize("rounds", [0, 1, 3])
def test_dropped_lines_are_near_lines_that_stay(spark, monkeypatch, rounds):
    monkeypatch.setattr(line_dedup, "ORDERED_ROUNDS", rounds)
    rows = [(i, f"{i % 45:06b} of the rows of this long table") for i in range(60)] + [(None, "000000 of the rows of this long tables")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = [r.text for r in drop_lines(docs).collect()]
    assert all(min(edits(t, k) for k in kept) <= 2 for _, t in rows)
    assert all(edits(a, b) > 2 for i, a in enumerate(kept) for b in kept[:i])


def test_short_lines_take_part(spark):
    """Every line but blank ones has a row; two edits from 24 code points, one from 12, exact repeats below."""
    rng = random.Random(4)
    base = ["".join(rng.choice("abcd句") for _ in range(n)) for n in (1, 2, 3, 8, 11, 12, 13, 14, 22, 23, 24, 25, 26, 30)]
    rows = [(i, "\n".join([*(changed(rng, rng.choice(base), rng.choice([0, 0, 1, 2])) for _ in range(5)), " ", ""])) for i in range(60)]
    docs = keyed(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1), "short")
    text = {r["__row"]: r.text for r in docs.collect()}
    lines = {(row, i): x.strip() for row, t in text.items() for i, x in enumerate(t.split("\n")) if x.strip()}
    got = {(r["__row"], r.line): r for r in line_classes(docs, least=1).collect()}
    assert set(got) == set(lines)
    distinct = sorted(set(lines.values()))
    allowed = lambda a, b: 2 if (n := min(len(a), len(b))) >= 24 else 1 if n >= 12 else 0
    near = [(a, b) for k, a in enumerate(distinct) for b in distinct[:k] if edits(a, b) <= allowed(a, b)]
    assert any(min(len(a), len(b)) < 24 for a, b in near)
    assert all(r.n_links == sum(lines[k] in p for p in near) for k, r in got.items())
    own = {k: x for k, x in lines.items() if len(x) < 12}
    assert all(got[k].kept == (k == min(j for j, y in own.items() if y == x)) for k, x in own.items())


def test_query_returns_short_lines(spark, tmp_path):
    spark.createDataFrame([(1, "Les.\nAll rights reserved."), (2, "All rights reserved.\n\nLes.")], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r.doc_id, r.line, r.class_doc, r.class_line, r.kept) for r in line_dedup.op9(spark, str(tmp_path)).collect())
    assert got == [(1, 0, 1, 0, True), (1, 1, 1, 1, True), (2, 0, 1, 1, False), (2, 2, 1, 0, False)]


def test_keys_and_signatures_are_taken_in_small_parts(monkeypatch):
    """Arrays over all lines of a batch left the cache; parts of any size give the same signatures."""
    rng = random.Random(3)
    lines = [changed(rng, "some line of this text " * rng.randint(1, 9), 5) for _ in range(300)]
    whole, sizes = line_dedup._signatures(lines), []
    real = line_dedup._signatures
    monkeypatch.setattr(line_dedup, "_signatures", lambda own: sizes.append(sum(map(len, own))) or real(own))
    for most in (1, 500, 1 << 15):
        sizes.clear()
        monkeypatch.setattr(line_dedup, "SIGNED", most)
        assert (signatures(lines) == whole).all() and max(sizes) < most + 250
    assert line_dedup.PARCEL <= 1 << 17
