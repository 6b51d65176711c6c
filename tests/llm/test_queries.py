from __future__ import annotations

import math

import pytest
from compare import differences, oracle_rows, spark_rows

from panelwright.llm.catalog import ORACLES, QUERIES


def test_one_query_per_operator():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck, sf_dir):
    got = spark_rows(QUERIES[name](spark, sf_dir))
    if name in ORACLES:
        assert differences(got, oracle_rows(duck, ORACLES[name])) is None
    assert got[0]
    docs = duck.sql("SELECT count(*), count(DISTINCT doc_id) FROM documents").fetchall()[0]
    if name not in ("op4_packing", "op6_chat_windows", "op9_line_dedup", "op11_embedding_whitening", "op13_prefix_trie"):
        assert len(got[0]) == docs[0]


def test_lossless(spark, duck, sf_dir):
    want = dict(duck.sql("SELECT doc_id, sha256(coalesce(text, '')) FROM documents").fetchall())
    assert {r.doc_id: r.decoded_sha256 for r in QUERIES["op7_merge_dropout"](spark, sf_dir).collect()} == want


def test_chat_digests(spark, duck, sf_dir):
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in QUERIES["op6_chat_windows"](spark, sf_dir).collect()}
    said = "coalesce(string_agg(coalesce(text,''), '' ORDER BY turn) FILTER (role = 'assistant'), '')"
    want = duck.sql(f"""SELECT conv_id, count(*), sha256(string_agg(role || chr(10) || coalesce(text,'') || chr(10), '' ORDER BY turn)),
        length({said}), sha256({said}) FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL VALUES
        (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')) GROUP BY 1""").fetchall()
    assert got == {r[0]: r[1:] for r in want}
    assert all(math.isfinite(x[2]) for x in got.values())
