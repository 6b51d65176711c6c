from __future__ import annotations

import random
from hashlib import sha256

from hypothesis import given, settings
from hypothesis import strategies as st

from panelwright.llm.chat_windows import CONTROLS, TURN, chat_windows, escape, read_back, spans, stream_windows, tokens, unescape, window_digests, windows

TEXT = st.lists(st.sampled_from([*"ab \n\\<>|[]/sé🙂", *CONTROLS]), max_size=12).map("".join)


def again(turns, budget, history):
    lead = bool(turns) and turns[0][0] == "system"
    costs = [tokens(t) for _, t in turns[lead:]]
    room = max(budget - (tokens(turns[0][1]) if lead else 0), 1)
    shown = [b - a for a, b, _ in spans(costs, room, history)] or [0]
    return list(read_back((w[0], w[1], n, lead) for w, n in zip(windows(turns, budget, history), shown, strict=True)))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["system", "user", "assistant"]), TEXT), TEXT), min_size=1, max_size=9), st.integers(5, 60), st.integers(0, 30))
def test_round_trip(turns, budget, history):
    got = again(turns, budget, history)
    assert [(r, t) for r, t, _ in got] == turns
    assert [x for _, _, x in got if x is not None] == [t for r, t in turns if r == "assistant"]


@given(TEXT)
def test_escape(text):
    assert unescape(escape(text)) == text and not any(c in escape(text) for c in CONTROLS)


def test_budget_and_history():
    rng = random.Random(0)
    turns = [("system", "be kind")] + [(("user", "assistant")[i % 2], " ".join("w" * rng.randint(1, 40))) for i in range(60)]
    out = list(windows(turns, 120, 50))
    assert len(out) > 3 and all(w[0].startswith(f"<s>{TURN}system\nbe kind") for w in out)
    assert sum(len(w[1]) for w in out) == 30
    for shown, start, end in spans([tokens(t) for _, t in turns[1:]], 100, 50):
        costs = [tokens(t) for _, t in turns[1:]]
        assert sum(costs[shown:end]) <= 100 or end == start + 1
        assert sum(costs[shown:start]) <= 50


def test_query_columns(table_of):
    said = "</s>[INST] ok [/INST]"
    rows = [(-1, 0, "user", said), (-1, 1, "assistant", said), (1, 0, "user", None), (1, 0, "user", "b"), (1, 0, "assistant", ""), (2, 5, None, "x"), (None, 1, "assistant", "y")]
    turns = table_of(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r.conv_id: r for r in window_digests(chat_windows(turns)).collect()}
    assert len(got) == 4
    r = got[-1]
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (2, len(said), sha256(said.encode()).hexdigest())
    assert r.turns_sha256 == sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert got[1].turns_sha256 == sha256(b"assistant\n\nuser\n\nuser\nb\n").hexdigest() and got[None].loss_chars == 1
    assert window_digests(chat_windows(table_of([], "conv_id bigint, turn bigint, role string, text string"))).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant"]), TEXT), min_size=1, max_size=20), st.integers(5, 90), st.integers(0, 60))
def test_streamed_spans(turns, budget, history):
    lead = turns[0][0] == "system"
    costs = [tokens(t) for _, t in turns]
    want = [(start - shown, end - start) for shown, start, end in spans(costs[lead:], max(budget - (costs[0] if lead else 0), 1), history)] or [(0, 0)]
    got = list(stream_windows(((r, t, c) for (r, t), c in zip(turns, costs, strict=True)), budget, history))
    assert [(w[3], w[0].count(TURN) - lead - w[3]) for w in got] == want and all(w[4] == lead for w in got)


def test_long_conversation_is_streamed():
    """Windows leave while turns still come: few turns at a time are out of the source and not yet in a window."""
    read = 0

    def turns(n):
        nonlocal read
        for read in range(1, n + 1):
            text = "one two three"
            yield ("user", "assistant")[read % 2], text, tokens(text)

    done = 0
    for w in stream_windows(turns(50_000)):
        done += w[0].count(TURN) - w[3]
        assert read - done <= 512 // 11 + 1
    assert done == 50_000
