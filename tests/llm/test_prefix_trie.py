from __future__ import annotations

import random
import zlib
from collections import defaultdict
from hashlib import sha256

import pytest

from panelwright.llm.catalog import QUERIES
from panelwright.llm.prefix_trie import build, end_digests, last_turns, prefix_trie, shared_heads, turn_ids

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
HARD = [
    (100, 0, "user", "hello"), (100, 1, "assistant", "hi there"), (100, 2, "user", "more"), (101, 0, "user", "hello"), (101, 1, "assistant", "hi there"),
    (102, None, None, None), (102, 0, "user", ""), (102, 0, "user", "tie"), (102, 0, "user", "tie"), (250, 5, "user", "no base here"), (251, 1, "x", "é🙂"),
    (None, 0, "user", "belongs to none"), (100, 3, "user", "x" * 20_000), (103, 0, "user", "hello"), (103, 1, "assistant", "hi there"), (300, 0, "", ""),
]


def by_turn(rows):
    out = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            said = (role or "", text or "")
            out[c].append(((turn is not None, turn or 0), sha256(f"{len(said[0])}:{said[0]}{said[1]}".encode()).hexdigest(), said))
    return {c: [x[2] for x in sorted(v)] for c, v in out.items()}


def rebuilt(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    return out


def slow(paths):
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)

    def below(p):
        own = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
        kids = [below(q) for q in children[p]]
        return sum(k[0] for k in kids) or 1, own + sum(k[1] for k in kids)

    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(paths[c]) == len(p))
        leaves, saved = below(p)
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves, saved, sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(trie):
    nodes = trie.nodes.join(end_digests(trie.ends), ["a", "b"], "left").collect()
    none = sha256(b"").hexdigest()
    return sorted(((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved, r.ends_sha256 or none) for r in nodes), key=repr)


@pytest.mark.parametrize("block", [1, 2, 8])
def test_hard_cases(table_of, block):
    df = table_of(HARD, SCHEMA)
    assert rows_of(prefix_trie(df, block)) == slow(by_turn(HARD))
    assert rows_of(build(*shared_heads(turn_ids(df)), block)) == slow(rebuilt(by_turn(HARD)))


def test_long_and_hot_conversations(table_of):
    """A conversation of a third of all rows, a first turn that most share, and whole copies."""
    rng = random.Random(5)
    rows = [(c, t, "user", "first" if t == 0 and c % 3 else f"{rng.randint(0, 2)}") for c in range(200, 420) for t in range(rng.randint(1, 6))]
    rows += [(7, t, "user", f"step {t % 3}") for t in range(40)] + [(c, t, "user", f"step {t % 3}") for c in (8, 9) for t in range(23 + c)]
    rows += [(c, t, "assistant", f"copy {t}") for c in range(500, 600) for t in range(3)]
    rng.shuffle(rows)
    df = table_of(rows, SCHEMA)
    assert rows_of(prefix_trie(df, 4)) == slow(by_turn(rows))
    assert rows_of(build(*shared_heads(turn_ids(df)))) == slow(rebuilt(by_turn(rows)))


def test_empty_table(table_of):
    df = table_of([], SCHEMA)
    trie = prefix_trie(df)
    assert trie.nodes.collect() == [] and end_digests(trie.ends).collect() == []


def test_texts_of_the_nodes(table_of):
    df = table_of(HARD, SCHEMA)
    got = {(r.conv_id, r.depth): (r.role, r.text) for r in last_turns(prefix_trie(df).nodes, df).collect()}
    own = by_turn(HARD)
    assert got.pop((100, 0)) == (None, None)
    assert all(said == own[c][d - 1] for (c, d), said in got.items()) and len(got) == len(slow(own)) - 1


def test_query_against_brute_force(spark, duck, sf_dir):
    rows = duck.sql("SELECT conv_id, turn, role, text FROM conversations").fetchall()
    got = sorted((tuple(r) for r in QUERIES["op13_prefix_trie"](spark, sf_dir).collect()), key=repr)
    assert got == slow(rebuilt(by_turn(rows)))


def test_digests_over_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        ends = spark.range(1000).selectExpr("CAST(id % 5 AS BIGINT) AS a", "CAST(0 AS BIGINT) AS b", "id AS conv_id")
        got = {r.a: r.ends_sha256 for r in end_digests(ends).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {k: sha256(",".join(str(i) for i in range(k, 1000, 5)).encode()).hexdigest() for k in range(5)}
