from __future__ import annotations

import random
from hashlib import sha256

from cases import TEXTS

from panelwright.llm.exact_dedup import chunk_ends, exact_dedup, fast_id, gear_table, strong_id


def weak():
    return lambda chunk: chunk[:1]  # made here, so that it travels with the query


def expected(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    best = {t: max((i for i in g if i is not None), default=None) for t, g in groups.items()}
    return sorted(((i, best[t or ""], len(groups[t or ""]), sha256((t or "").encode()).hexdigest()) for i, t in rows), key=repr)


def test_against_brute_force(texts, no_texts):
    for names in ((fast_id,), (weak(), strong_id)):
        got = exact_dedup(texts, names=names).collect()
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == expected(TEXTS)
        assert sum(r.kept for r in got) == len({t or "" for _, t in TEXTS})
        assert all(r.doc_id == r.keep_id for r in got if r.kept)
    assert exact_dedup(no_texts).collect() == []


def test_weak_identifiers_are_refused(texts):
    import pytest

    with pytest.raises(ValueError):
        exact_dedup(texts, names=(weak(),))


def test_chunks_cover_and_resynchronise():
    rng, gear = random.Random(3), gear_table()
    text = bytes(rng.choice(b"abcdefgh \n") for _ in range(60_000))
    ends = chunk_ends(text, gear)
    assert ends == sorted(set(ends)) and ends[-1] == len(text)
    sizes = [b - a for a, b in zip([0, *ends], ends, strict=False)]
    assert max(sizes) <= 16_384 and min(sizes[:-1]) >= 512
    moved = chunk_ends(b"inserted" + text, gear)
    pieces = lambda t, e: {t[a:b] for a, b in zip([0, *e], e, strict=False)}
    assert len(pieces(text, ends) & pieces(b"inserted" + text, moved)) > len(ends) // 2
    assert chunk_ends(b"", gear) == [] and chunk_ends(b"x" * 100_000, gear)[-1] == 100_000
