"""Texts that are one long run of something: each is read within seconds and gives what its definition says."""

from __future__ import annotations

import time
import tracemalloc

import pytest

from panelwright.llm.bpe_ids import Encoder
from panelwright.llm.packing import pack
from panelwright.llm.secret_scan import ADDED, compiled, spans_of
from panelwright.llm.simhash_join import AT_A_TIME, fingerprint, majority, shingle_hashes


@pytest.mark.parametrize("run", [" ", "\n", "\u00a0", "\u3000"])
def test_long_runs_of_white_space_are_encoded(run):
    encoder, text = Encoder(), "a" + run * 1_200_000 + "b"
    start = time.perf_counter()
    assert encoder.encode(text).tolist() == encoder.library().encode(text, add_special_tokens=False).ids
    assert time.perf_counter() - start < 60


def test_packing_takes_them(spark):
    df = spark.createDataFrame([(1, "a" + " " * 1_200_000 + "b"), (2, "short")], "doc_id bigint, text string")
    pieces = pack(df).collect()
    assert sum(r.length for r in pieces if r.id == 1) == 1_200_001 + 1


@pytest.mark.parametrize("text", ["eyJ" * 400_000, "eyJ" * 100_000 + "." + "eyJ" * 100_000, "eyJaaaaaaaa." * 100_000])
def test_runs_of_headers_are_read_once(text):
    start = time.perf_counter()
    spans_of(text.encode(), compiled())
    assert time.perf_counter() - start < 10


def test_tokens_are_still_found():
    token = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3.SflKxwRJSMeKKF2QT4"
    for before in ("", " ", "token: ", "é", "."):
        found = [s for s in spans_of((before + token + " end").encode(), compiled()) if s[0] == "jwt"]
        assert found == [("jwt", len(before), len(before) + len(token), token)]
    assert "jwt" in ADDED


def test_a_long_text_is_counted_in_blocks():
    text = b" ".join(b"w%d" % (i * i % 999_983) for i in range(600_000))
    tracemalloc.start()
    got = fingerprint(text)
    assert tracemalloc.get_traced_memory()[1] < 120_000_000
    tracemalloc.stop()
    hashes = shingle_hashes(text, 3)
    bits = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))
    assert got == bits - (1 << 64 if bits >> 63 else 0) and len(hashes) > AT_A_TIME
    assert majority([]) == 0


def test_slices_are_bounded_by_bytes_too():
    import pyarrow as pa

    from panelwright.llm.common import SLICE_BYTES, sliced

    long = pa.RecordBatch.from_arrays([pa.array(["x" * 100_000] * 200)], ["text"])
    short = pa.RecordBatch.from_arrays([pa.array(["y"] * 5000)], ["text"])
    got = list(sliced([long, short, long.slice(0, 0)]))
    assert [b.num_rows for b in got[-4:]] == [2048, 2048, 904, 0]
    assert max(b.nbytes for b in got) <= SLICE_BYTES and len(got) > 10
    assert pa.Table.from_batches(got).column(0).to_pylist() == long.column(0).to_pylist() + short.column(0).to_pylist()
