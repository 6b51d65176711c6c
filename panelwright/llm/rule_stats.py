"""Rule statistics of single texts: counts that need nothing but the text."""

from __future__ import annotations

SPACE = b" \t\n\v\f\r"
CONTINUATION = bytes(range(0x80, 0xC0))
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_echoes", "n_top")


def without(text: bytes, drop: bytes) -> int:
    return len(text.translate(None, drop))


def repeated_window_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` consecutive words found at least twice, the first one included.

    Windows are numbered exactly by doubling: pairs of numbered halves are numbered again, so equal numbers mean
    equal words. ``window`` is a power of two.
    """
    import numpy as np

    if len(words) <= window:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) == len(words):
        return 0
    span = 1
    while span < window:
        pair = ids[:-span] * np.int64(len(words) + 1) + ids[span:]
        seen, ids, n = np.unique(pair, return_inverse=True, return_counts=True)
        if len(seen) == len(pair):
            return 0
        span *= 2
    starts = np.flatnonzero(n[ids] > 1)
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + window, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def counts(text: bytes) -> tuple[int, ...]:
    """The ``COUNTS`` of one UTF-8 text; an empty text has zeros."""
    from collections import Counter

    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    tally = Counter(words)
    return (
        len(words), without(text, SPACE + CONTINUATION), len(text) - without(text, SYMBOLS), len(lines) - len(set(lines)),
        repeated_window_words(words), len(lines), len(text) - without(text, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        len(text) - without(text, b"0123456789"), len(text) - without(text, b"!?;:=\"'()[]{}/\\_@~^`"),
        sum(map(bytes.__eq__, words, words[1:])), max(tally.values(), default=0),
    )
