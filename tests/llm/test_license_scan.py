from __future__ import annotations

import re
from fractions import Fraction

from cases import TEXTS

from panelwright.llm.license_scan import PHRASES, license_scan, need, template_words

LINES = [
    "CC BY cc-by cc by by", "general public license general public license", "All Rights Reserved.", "permission is hereby granted, free of charge to any person",
    "released under the mit license", "Released under the license MIT it is", "under the mit", "éall rights reserved all\nrights reserved", "nothing here",
    "licensed under cc by nc 4.0", "This work is licensed under the GNU Public License, version 3.", "x" * 9 + " " + "all rights reserved " * 40,
]


def slow(text: str):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    words = find(low)
    places = [(i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    best, labels = 0.0, {label for _, label in places}
    for line in low.split("\n"):
        own = set(find(line))
        for label, t in template_words():
            hit = len(own & set(t))
            if Fraction(hit, len(t)) >= Fraction(4, 5):
                best = max(best, hit / len(t))
                labels.add(label)
    at = [i for i, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})), ",".join(sorted(labels)), 1.0 if at else best


def test_against_brute_force(table_of, no_texts):
    rows = TEXTS + [(100 + i, t) for i, t in enumerate(LINES)] + [(200, "\n".join(LINES)), (200, "\n".join(LINES))]
    got = license_scan(table_of(rows, "doc_id bigint, text string")).collect()
    key = lambda r: repr(r)
    own = sorted(((r.id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in got), key=key)
    assert own == sorted(((i, *slow(t or "")) for i, t in rows), key=key)
    assert license_scan(no_texts).collect() == []


def test_plan_is_native(texts):
    plan = license_scan(texts)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_threshold():
    assert [need(n) for n in (1, 5, 6, 10)] == [1, 4, 5, 8]
