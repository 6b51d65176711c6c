from __future__ import annotations

import corpus_pipeline
from test_line_dedup import edits

from panelwright.llm.bpe_ids import Encoder
from panelwright.llm.common import table
from panelwright.llm.quality_rules import quality_rules
from panelwright.llm.simhash_join import shingle_hashes


def test_stages_against_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = {r.doc_id: r.text for r in docs.collect()}

    good = {r.id for r in quality_rules(docs, table(spark, sf_dir, "labels")).collect() if r.kept}
    one = corpus_pipeline.quality(spark, docs, sf_dir)
    assert {r.doc_id for r in one.collect()} == good and one.columns == docs.columns

    two = corpus_pipeline.lines(spark, one, sf_dir)
    assert two.columns == docs.columns
    want = {}
    parts = {d: [x.strip() for x in rows[d].split("\n")] for d in sorted(good)}
    lines = sorted({x for p in parts.values() for x in p if len(x) >= 24})
    near: dict[str, set[str]] = {x: {x} for x in lines}
    for k, a in enumerate(lines):
        for b in lines[:k]:
            if abs(len(a) - len(b)) <= 2 and a[: len(a) // 3 - 2] and (a[:6] == b[:6] or a[-6:] == b[-6:] or a[len(a) // 2 - 4 : len(a) // 2] in b) and edits(a, b) <= 2:
                merged = near[a] | near[b]
                for x in merged:
                    near[x] = merged
    seen: set[str] = set()
    for d, p in parts.items():
        out = []
        for x, raw in zip(p, rows[d].split("\n"), strict=True):
            if len(x) < 24 or not near[x] & seen:
                out.append(raw)
                if len(x) >= 24:
                    seen.add(x)
        if "\n".join(out).strip():
            want[d] = "\n".join(out)
    assert {r.doc_id: r.text for r in two.collect()} == want
    assert all(r.n_chars == len(r.text) for r in two.collect())

    three = corpus_pipeline.near_duplicates(spark, two, sf_dir)
    kept = {r.doc_id: r.text for r in three.collect()}
    sets = {d: set(shingle_hashes(t.encode(), 5)) for d, t in want.items()}
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    assert set(kept) <= set(want)
    assert all(any(alike(d, e) for e in want if e != d) for d in set(want) - set(kept))
    found = [(a, b) for a in kept for b in kept if a < b and alike(a, b)]
    assert len(found) <= 0.02 * len(want)  # pairs whose fingerprints are too far apart

    four = corpus_pipeline.secrets(spark, three, sf_dir)
    marked = {r.doc_id: r.text for r in four.collect()}
    assert set(marked) == set(kept) and all(marked[d] == t or "[SECRET]" in marked[d] for d, t in kept.items())

    encoder = Encoder()
    pieces = corpus_pipeline.packing(spark, four, sf_dir).collect()
    own: dict = {}
    for r in sorted(pieces, key=lambda r: (r.doc_id, r.start)):
        own.setdefault(r.doc_id, []).extend(r.ids)
    assert own == {d: [*encoder.encode(t).tolist(), 0] for d, t in marked.items()}


def test_run(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_dedup", "secret_scan", "packing"]
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() and {"doc_id", "sequence_id", "offset", "ids"} <= set(out.columns)
