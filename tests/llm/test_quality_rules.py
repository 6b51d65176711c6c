from __future__ import annotations

import random

import numpy as np
import pytest
from cases import TEXTS

from panelwright.llm.quality_rules import calibrate, keep_good, quality_rules
from panelwright.llm.rule_stats import repeated_window_words


def slow_counts(text: str):
    words = [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in text).split(" ") if w]
    wins = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    hit = {p for i, w in enumerate(wins) if wins.count(w) > 1 for p in range(i, i + 8)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(hit)


def test_repeated_windows():
    rng = random.Random(0)
    for _ in range(200):
        words = [rng.choice([b"a", b"b"]) for _ in range(rng.randint(0, 60))]
        assert repeated_window_words(words) == slow_counts(" ".join(w.decode() for w in words))[4]


def test_counts_and_edges(texts, no_texts, table_of):
    labels = table_of([(1, 1), (5, 1), (5, None), (9, 0), (None, 1)], "doc_id bigint, quality int")
    got = sorted(quality_rules(texts, labels).collect(), key=lambda r: (r.id is None, r.id or 0))
    for r, (i, t) in zip(got, sorted(TEXTS, key=lambda x: (x[0] is None, x[0] or 0)), strict=True):
        if i != 9:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == slow_counts(t or "")
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert quality_rules(no_texts, labels).collect() == []
    no_labels = table_of([], "doc_id bigint, quality int")
    assert all(r.kept != r.base_failed for r in quality_rules(texts, no_labels).collect())


def test_forest_rejects_labelled_junk(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    good = [(i, " ".join(word() for _ in range(200))) for i in range(400)]
    junk = [(1000 + i, " ".join(word() + "###" for _ in range(200))) for i in range(60)]
    docs = spark.createDataFrame(good + junk, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i < 1000)) for i, _ in good[:200] + junk[:30]], "doc_id bigint, quality int")
    kept = {r.id for r in quality_rules(docs, labels).collect() if r.kept}
    assert not kept & {i for i, _ in junk} and len(kept) >= 395
    rows = keep_good(docs, labels)
    assert rows.columns == docs.columns and {r.doc_id for r in rows.collect()} == kept


@pytest.mark.parametrize("most", [0.0, 0.1])
def test_threshold(most):
    scores, good = np.array([0.1, 0.2, 0.3, 0.3, 0.5, 0.9]), np.array([True, True, True, True, False, False])
    t = calibrate(scores, good, most)
    assert 0.3 <= t < 0.5
    assert calibrate(scores, np.ones(6, bool)) == float("inf")


def test_every_labelled_row_takes_part(spark):
    """The only bad row is the one that 20,000 rows by hash would leave out; repeated and unlabelled rows beside it."""
    from pyspark.sql import functions as F

    ids = spark.range(21_000).select(F.col("id").alias("doc_id"))
    last = ids.orderBy(F.xxhash64("doc_id").desc()).first()["doc_id"]
    word = "transform(sequence(0, 24), i -> substr(md5(concat(doc_id, '-', i)), 1, 5{}))"
    text = F.when(F.col("doc_id") == last, F.expr(f"concat_ws('### ', {word.format('')})")).otherwise(F.expr(f"concat_ws(' ', {word.format(' + doc_id % 3')})"))
    docs = ids.withColumn("text", text)
    labels = ids.withColumn("quality", (F.col("doc_id") != last).cast("int"))
    kept = {r.id: r.kept for r in quality_rules(docs.union(docs.limit(50)), labels).collect()}
    assert not kept[last] and sum(not k for k in kept.values()) <= 22
    assert {r.doc_id for r in keep_good(docs, labels).collect()} == {i for i, k in kept.items() if k}


def test_fit_of_many_rows_is_that_of_the_arrays(spark):
    """Draws and threshold of the executors against the driver's, with ties, without bad rows and without good ones."""
    from panelwright.llm.quality_rules import RATIOS, SUBSAMPLE, TREES, drawn, grow, threshold_among

    rng = np.random.default_rng(3)
    x = rng.integers(0, 30, (3000, len(RATIOS))) / 10
    good = rng.random(3000) < 0.9
    x[~good] += 1
    table = lambda some: spark.createDataFrame([(int(i), bool(good[i]), *map(float, x[i])) for i in np.flatnonzero(some)], "id bigint, good boolean, " + ", ".join(f"{k} double" for k in RATIOS))
    rows = table(np.ones(3000, bool))
    draws = drawn(rows.filter("good"), int(good.sum()))
    assert [len(d) for d in draws] == [SUBSAMPLE] * TREES and len({d.tobytes() for d in draws}) == TREES
    assert {tuple(r) for d in draws for r in d} <= {tuple(r) for r in x[good]}
    forest = grow(None, x.min(0), x.max(0), draws=draws)
    scores = forest.score(x)
    for most in (0.0, 0.001, 0.05):
        assert threshold_among(rows, forest, int(good.sum()), most) == calibrate(scores, good, most)
    assert threshold_among(table(~good), forest, 0) == calibrate(scores[~good], good[~good])
