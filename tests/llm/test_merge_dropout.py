from __future__ import annotations

import pytest
import sentencepiece
from cases import TEXTS
from hypothesis import given, settings
from hypothesis import strategies as st

from panelwright.llm import merge_dropout
from panelwright.llm.merge_dropout import UNITS, Encoder, Pieces, decode, encode, model_path

PIECES = Pieces()
HARD = st.text(st.sampled_from([*"abe thing.,;\n  ▁_é你🙂\0²<s>"]), max_size=60)


def normal(text: str) -> bool:
    """Whether the library reads the text as it is: it takes a literal mark for a blank."""
    return bool(text) and "▁" not in text and "\0" not in text


@settings(max_examples=200, deadline=None)
@given(HARD)
def test_without_dropout_it_is_the_library(text):
    if normal(text):
        want = sentencepiece.SentencePieceProcessor(model_file=model_path()).encode(text)
        assert Encoder(PIECES, 0.0).encode(text) == want


@settings(max_examples=200, deadline=None)
@given(HARD, st.integers(0, 5), st.sampled_from([0.1, 0.5, 1.0]))
def test_round_trip(text, number, rate):
    assert PIECES.decode(Encoder(PIECES, rate, seed=3).encode(text, number)) == text


def test_segmentations_vary_and_repeat():
    text = "international understanding " * 50
    cuts = {tuple(Encoder(PIECES, 0.3).unit(" understanding", v)) for v in range(4)}
    assert len(cuts) > 1
    assert Encoder(PIECES, 0.3).encode(text, 1) == Encoder(PIECES, 0.3).encode(text, 1) != Encoder(PIECES, 0.3).encode(text, 2)
    assert Encoder(PIECES, 0.3, seed=1).encode(text) != Encoder(PIECES, 0.3, seed=2).encode(text)
    assert len(Encoder(PIECES, 1.0).encode(text)) > len(Encoder(PIECES, 0.0).encode(text))


def test_finer_units_change_nothing(monkeypatch):
    text = "Well, it works. And: so 3.5 does (this), x_. y². É."
    fine = Encoder(PIECES, 0.0).encode(text)
    monkeypatch.setattr(PIECES, "units", UNITS)
    assert Encoder(PIECES, 0.0).encode(text) == fine


def test_tables(texts, no_texts):
    done = encode(texts)
    rows = done.collect()
    assert sorted(((r.id, r.text) for r in decode(done).collect()), key=repr) == sorted(((i, t or "") for i, t in TEXTS), key=repr)
    assert len({tuple(r.ids) for r in rows if r.id == 5}) == 1 and all(r.ids == [] for r in rows if r.id in (2, 3))
    assert encode(no_texts).collect() == []


@pytest.mark.parametrize("text", ["", " ", "\n"])
def test_blank(text):
    assert PIECES.decode(Encoder(PIECES).encode(text)) == text


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from([*" theinrdoa._🙂"]), min_size=1, max_size=30), st.integers(0, 2**63), st.sampled_from([0.0, 0.3, 0.9]))
def test_both_agendas_agree(word, key, rate):
    merged = [f(list(word.replace(" ", "▁")), int(rate * (1 << 32)), key) for f in (PIECES._merge_short, PIECES._merge_long)]
    assert merged[0] == merged[1]


def test_every_occurrence_draws_for_itself():
    """A word's occurrences take all its segmentations, each as often as independent skips of 10 % give it."""
    word, n = " understanding", 20_000
    candidates = PIECES.cut_unit(word, ())[0]
    encoder = Encoder(PIECES)
    cuts = [tuple(encoder.unit(word, k, 5)) for k in range(n)]
    assert len(set(cuts)) > 8 and {PIECES.decode(c) for c in cuts} == {word[1:]}
    alone = [tuple(PIECES.encode_unit(word, 0.1, int(k))) for k in encoder.draws(range(n), 6)]
    taken = encoder.taken(encoder.draws(range(n), 5))
    assert abs((taken >= candidates).sum() - n * 0.9**candidates) < 5 * (n / 4) ** 0.5
    for cut in set(cuts) | set(alone):
        assert abs(cuts.count(cut) - alone.count(cut)) < 5 * (n / 2) ** 0.5
    text = word * n
    assert Encoder(PIECES).encode(text[1:], 5) == [i for c in cuts for i in c]


@pytest.mark.parametrize("word", [" understanding", " a▁b", "🙂é", "\n", "   "])
def test_given_skips(word):
    n, ids = PIECES.cut_unit(word, ())
    assert ids == PIECES.encode_unit(word)
    assert all(PIECES.decode([0, *PIECES.cut_unit(word, (k,))[1]]) in (word, word[1:]) for k in range(n))
    assert PIECES.cut_unit(word, tuple(range(1000)))[1] == PIECES.encode_unit(word, 1.0)


def test_what_is_remembered_does_not_change_the_ids(monkeypatch):
    """The same ids with a full memory, an empty one and none, from words with no skip to many."""
    text = " ".join(f"understanding internationalisation {w} é🙂▁" for w in ("of", "the", "rewording", "a" * 30)) * 30
    encoder = Encoder(PIECES, 0.4)
    first = encoder.encode(text, 3)
    assert encoder.encode(text, 3) == first and sum(map(len, encoder.once)) and encoder.often
    for name in ("REMEMBERED", "REMEMBERED_SKIPS"):
        monkeypatch.setattr(merge_dropout, name, 0)
    bare = Encoder(PIECES, 0.4)
    assert bare.encode(text, 3) == first and not bare.known and not any(bare.once)
    assert PIECES.decode(first) == text
    units = PIECES.units.findall(" " + text)
    assert [i for k, u in enumerate(units) for i in bare.unit(u, k, 3)] == first


def test_tasks_of_a_process_share_what_is_remembered():
    """Pieces were read anew, and words worked out anew, for every task."""
    own = merge_dropout.shared_encoder(None, 0.1, 17)
    assert own is merge_dropout.shared_encoder(None, 0.1, 17) and own.pieces is merge_dropout.shared_pieces(None)


def test_a_word_without_room_is_worked_out_once(monkeypatch):
    """One pass with the skips as they are drawn gives the ids of a pass per skip."""
    words = [f"unremembered{i}words" for i in range(60)]
    remembering = merge_dropout.Encoder(PIECES, 0.4, 5)
    want = [list(remembering.unit(" " + w, k, 9)) for k, w in enumerate(words)]
    assert remembering.often
    calls, real = [], merge_dropout.Pieces.cut_drawn
    monkeypatch.setattr(merge_dropout, "REMEMBERED", 0)
    monkeypatch.setattr(merge_dropout.Pieces, "cut_drawn", lambda self, *a: calls.append(1) or real(self, *a))
    bare = merge_dropout.Encoder(PIECES, 0.4, 5)
    assert [list(bare.unit(" " + w, k, 9)) for k, w in enumerate(words)] == want and len(calls) == len(words)
