from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from cases import TEXTS
from tokenizers import Tokenizer

from panelwright.llm import packing
from panelwright.llm.bpe_ids import Encoder


def slow_cost(places, penalty, length):
    """Least cost over all cuts, pair by pair."""
    at, halves = [0, *places], {length >> k for k in range(packing.HALVINGS + 1)}
    best = [0] + [None] * len(places)
    for j in range(1, len(at)):
        options = []
        for i in range(j):
            n = at[j] - at[i]
            if n <= length and best[i] is not None:
                options.append(best[i] + (0 if n in halves else length - n) + penalty[j - 1])
        best[j] = min(options)
    return best[-1]


@pytest.mark.parametrize("seed", range(30))
def test_cuts_are_optimal(seed):
    rng = random.Random(seed)
    places, at = [], 0
    for _ in range(rng.randint(1, 60)):
        at += rng.choice([1, 2, 5, 16])
        places.append(at)
    penalty = [rng.choice([0, 4, 10]) for _ in places]
    cuts = packing.best_cuts(places, penalty, 64)
    pen, total = dict(zip(places, penalty, strict=True)), 0
    for a, b in zip([0, *cuts], cuts, strict=False):
        n = b - a
        assert 0 < n <= 64
        total += (0 if n in (64, 32, 16) else 64 - n) + pen[b]
    assert cuts[-1] == places[-1] and total == slow_cost(places, penalty, 64)


def test_ids_are_the_tokenizers():
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    fast = Encoder()
    for text in [*(t or "" for _, t in TEXTS), "a  b \n c\t", "x<|endoftext|>y 'll don't 12ab ñ 你"]:
        assert fast.encode(text).tolist() == slow.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("block", [64, 1 << 20])
def test_pieces(texts, no_texts, monkeypatch, block):
    monkeypatch.setattr(packing, "BLOCK", block)
    encoder = Encoder()
    rows = packing.pack(texts.coalesce(1), length=128).collect()
    docs, pieces = {}, {}
    for i, t in TEXTS:
        docs.setdefault(i, []).append([*encoder.encode(t or "").tolist(), 0])
    for r in rows:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        pieces.setdefault(r.sequence_id, []).append(r)
    for own in pieces.values():
        own.sort(key=lambda r: r.offset)
        assert own[0].offset == 0 and sum(r.length for r in own) <= 128
        assert all(a.offset + a.length == b.offset for a, b in zip(own, own[1:], strict=False))
    for i, lists in docs.items():
        own = sorted((r for r in rows if r.id == i), key=lambda r: (r.start, r.length))
        if len(lists) == 1:
            assert sum((r.ids for r in own), []) == lists[0] and all(r.doc_tokens == len(lists[0]) for r in own)
        assert sum(r.length for r in own) == sum(map(len, lists))
    assert packing.pack(no_texts).collect() == []
    with pytest.raises(ValueError):
        packing.pack(texts, length=100)


def test_little_padding(spark, sf_dir):
    rows = packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet").coalesce(1), with_ids=False).groupBy("sequence_id").sum("length").collect()
    sizes = [r[1] for r in rows]
    padding = sum(0 if n & (n - 1) == 0 else 1024 - n for n in sizes)
    assert padding < 0.01 * sum(sizes) + 1024
