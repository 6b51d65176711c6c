"""SentencePiece encoding with seeded merge-dropout, and its decoding.

Merges of a public merge-type (BPE) model are worked off an agenda, best score first.  Each candidate that comes up is
skipped with the dropout rate, on its own wherever the word stands: keyed hashes of the seed, the document and the
word's place tell how many candidates are taken before the next skip.  What is remembered of a word are its candidates
and ids after given skips, so every occurrence draws for itself and results can be repeated.  All of them decode to the
same characters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import pairwise, repeat
from operator import add

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import per_batch, query, table

DROPOUT, SEED = 0.1, 17
#: Words up to this length are remembered, the first so many as they are and with given skips; the others are worked out
#: each time.
REMEMBERED_CHARS, REMEMBERED, REMEMBERED_SKIPS = 24, 160_000, 480_000
SPACE = "▁"
#: A literal SPACE in the text; no piece has this string, so it is spelt in bytes.
LITERAL_SPACE = "\0" + SPACE
UNITS = re.compile(r" *[^ \n]+|\n| +")
#: Finer units, for models without a piece in which a letter is followed by one of these marks.
LETTER, MARKS = "[A-Za-zÀ-ÖØ-öø-ÿ]", "[.,;:!?]"
FINE_UNITS = re.compile(rf" *{LETTER}+(?={MARKS})| *[^ \n]+|\n| +")
CROSSING = re.compile(LETTER + MARKS)
_MASK = (1 << 64) - 1
_STEP = 0x9E3779B97F4A7C15
#: Bits of an agenda entry that hold the place, a number above all entries, and the longest word without a heap.
PLACE_BITS, NEVER, SHORT = 40, 1 << 62, 20


def mix(x: int) -> int:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & _MASK
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & _MASK
    return x ^ (x >> 31)


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """Pieces, scores and byte ids of a model."""

    def __init__(self, path: str | None = None):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path or model_path())
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i): i for i in plain}
        # Pieces by rank, best score first; an agenda entry is a rank and a place in one number.
        self.ranked = sorted(self.ids, key=lambda p: (-sp.get_score(self.ids[p]), p))
        self.ranks = {p: r << PLACE_BITS for r, p in enumerate(self.ranked)}
        self.orders = {p: r for r, p in enumerate(self.ranked)}
        self.units = UNITS if any(map(CROSSING.search, self.ids)) else FINE_UNITS
        self.first_byte = next(i for i in range(sp.get_piece_size()) if sp.is_byte(i))
        self.raw = [b""] * sp.get_piece_size()
        for p, i in self.ids.items():
            self.raw[i] = p.replace(SPACE, " ").encode("utf-8", "surrogatepass")
        self.raw[self.first_byte : self.first_byte + 256] = [bytes([b]) for b in range(256)]

    def spell(self, symbol: str) -> list[int]:
        """The id of a symbol, or those of its bytes."""
        i = self.ids.get(symbol)
        if i is not None:
            return [i]
        return [self.first_byte + b for b in (SPACE if symbol == LITERAL_SPACE else symbol).encode("utf-8", "surrogatepass")]

    def encode_unit(self, unit: str, rate: float = 0.0, key: int = 0) -> list[int]:
        """Ids of one word with the blanks before it.

        The agenda holds a number per candidate: the piece's rank above the place of its first character, so the
        least number is the best piece, leftmost.  A merge takes its own candidate off and renews the two beside it.
        """
        symbols = list(unit.replace(" ", SPACE)) if SPACE not in unit else [SPACE if c == " " else LITERAL_SPACE if c == SPACE else c for c in unit]
        merge = self._merge_short if len(symbols) <= SHORT else self._merge_long
        ids, out = self.ids, []
        for x in merge(symbols, int(rate * (1 << 32)), key):
            i = ids.get(x)
            if i is None:
                out += self.spell(x)
            else:
                out.append(i)
        return out

    def _merge_short(self, symbols: list[str], limit: int, key: int) -> list[str]:
        """A plain list is the agenda: ``agenda[i]`` is the candidate of symbols ``i`` and ``i + 1``."""
        ranks, ranked = self.ranks.get, self.ranked
        starts = list(range(len(symbols)))
        agenda = [ranks(a + b, NEVER) + i for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False))]
        while agenda:
            entry = min(agenda)
            if entry >= NEVER:
                break
            i = agenda.index(entry)
            if limit and ((entry ^ key) * 0xD6E8FEB86659FD93 & _MASK) >> 32 < limit:
                agenda[i] = NEVER
                continue
            symbols[i] = piece = ranked[entry >> PLACE_BITS]
            del symbols[i + 1], starts[i + 1], agenda[i]
            if i < len(agenda):
                agenda[i] = ranks(piece + symbols[i + 1], NEVER) + starts[i]
            if i:
                agenda[i - 1] = ranks(symbols[i - 1] + piece, NEVER) + starts[i - 1]
        return symbols

    def cut_unit(self, unit: str, skips: tuple[int, ...]) -> tuple[int, list[int]]:
        """How many candidates come up after the last of ``skips``, and the ids, if just those are skipped (by number)."""
        if not skips:
            return self.cut_drawn(unit, NEVER, iter(()))
        n, ids = self.cut_drawn(unit, skips[0], iter([b - a - 1 for a, b in pairwise(skips)] + [NEVER]))
        return n - (skips[-1] + 1), ids

    def cut_drawn(self, unit: str, first: int, further: Iterator[int]) -> tuple[int, list[int]]:
        """How many candidates come up, and the ids, if ``first`` candidates are taken before one is skipped, and as many as
        ``further`` tells before each later skip.

        The agenda holds ranks only: of equal ones the first is the leftmost.
        """
        symbols = list(unit.replace(" ", SPACE)) if SPACE not in unit else [SPACE if c == " " else LITERAL_SPACE if c == SPACE else c for c in unit]
        orders, ranked = self.orders.get, self.ranked
        agenda = list(map(orders, map(add, symbols, symbols[1:]), repeat(NEVER)))
        n, left = 0, first
        while agenda:
            order = min(agenda)
            if order == NEVER:
                break
            i = agenda.index(order)
            n += 1
            if not left:
                agenda[i], left = NEVER, next(further)
                continue
            left -= 1
            symbols[i] = piece = ranked[order]
            del symbols[i + 1], agenda[i]
            if i < len(agenda):
                agenda[i] = orders(piece + symbols[i + 1], NEVER)
            if i:
                agenda[i - 1] = orders(symbols[i - 1] + piece, NEVER)
        ids = list(map(self.ids.get, symbols))
        if None in ids:
            ids = [i for x in symbols for i in self.spell(x)]
        return n, ids

    def _merge_long(self, symbols: list[str], limit: int, key: int) -> list[str]:
        """A heap is the agenda; merged symbols stay as empty strings, linked over."""
        ranks, ranked = self.ranks, self.ranked
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [ranks[pair] + i for i, pair in enumerate(map(str.__add__, symbols, symbols[1:])) if pair in ranks]
        heapify(agenda)
        place = (1 << PLACE_BITS) - 1
        while agenda:
            entry = heappop(agenda)
            i = entry & place
            j = after[i]
            piece = ranked[entry >> PLACE_BITS]
            if j >= n or symbols[i] + symbols[j] != piece or not symbols[i]:
                continue  # one of the two has been merged elsewhere
            if limit and ((entry ^ key) * 0xD6E8FEB86659FD93 & _MASK) >> 32 < limit:
                continue
            symbols[i], symbols[j] = piece, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                rank = ranks.get(piece + symbols[k])
                if rank is not None:
                    heappush(agenda, rank + i)
            h = before[i]
            if h >= 0:
                rank = ranks.get(symbols[h] + piece)
                if rank is not None:
                    heappush(agenda, rank + h)
        return [x for x in symbols if x]

    def decode(self, ids) -> str:
        """The text that ``ids`` were made from."""
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "surrogatepass")[1:]  # without the blank that leads every text


class Encoder:
    """Encodes texts; every occurrence of a word draws its own dropout."""

    def __init__(self, pieces: Pieces, rate: float = DROPOUT, seed: int = SEED):
        from math import inf, log1p

        self.pieces, self.rate, self.seed = pieces, rate, seed
        # Candidates taken before a skip are geometric: the logarithm of a uniform number over that of 1 - rate.
        self.scale = -inf if rate <= 0 else 0.0 if rate >= 1 else 1 / log1p(-rate)
        # Candidates and ids of a word without a skip, with one by its place, and with more.  Tuples of numbers, which
        # the collector leaves alone.
        self.known: dict[str, tuple[int, tuple[int, ...]]] = {}
        self.once: list[dict[str, tuple[int, tuple[int, ...]]]] = [{} for _ in range(REMEMBERED_CHARS + 1)]
        self.often: dict[tuple[str, tuple[int, ...]], tuple[int, tuple[int, ...]]] = {}
        self.room = REMEMBERED_SKIPS

    def draws(self, places, number: int):
        """A 64-bit hash per place of a document, as mix() makes it."""
        import numpy as np

        return self._mixed(np.asarray(places).astype(np.uint64) * np.uint64(_STEP) + np.uint64(mix((self.seed << 32 ^ number) & _MASK)))

    def again(self, draws):
        """The hash after each, for a word's next skip."""
        import numpy as np

        return self._mixed(draws + np.uint64(_STEP))

    @staticmethod
    def _mixed(x):
        import numpy as np

        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    def taken(self, draws):
        """How many candidates are taken before the next skip."""
        import numpy as np

        return np.minimum(np.log(((draws >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) * self.scale, 1e15).astype(np.int64)

    def _cut(self, unit: str, skips: tuple[int, ...]) -> tuple[int, tuple[int, ...]]:
        n, ids = self.pieces.cut_unit(unit, skips)
        return n, tuple(ids)

    def _skipping(self, unit: str, skips: tuple[int, ...]) -> tuple[int, tuple[int, ...]]:
        """``cut_unit``, remembered while there is room."""
        known, key = (self.once[skips[0]], unit) if len(skips) == 1 else (self.often, (unit, skips))
        got = known.get(key)
        if got is None:
            got = self._cut(unit, skips)
            if self.room > 0:
                self.room -= 1
                known[key] = got
        return got

    def _further(self, second: int, again: int) -> Iterator[int]:
        """How many candidates are taken before each skip after a word's first."""
        from math import log

        yield second
        while True:
            again = mix(again + _STEP & _MASK)
            yield int(min(log(((again >> 11) + 0.5) * 2.0**-53) * self.scale, 1e15))

    def _occurrence(self, unit: str, first: int, second: int, draw: int, again: int) -> Sequence[int]:
        """Ids of a word whose first skips come after ``first`` and ``second`` candidates; ``again`` draws further ones."""
        if len(unit) > REMEMBERED_CHARS:
            return self.pieces.encode_unit(unit, self.rate, draw)
        further = self._further(second, again)
        got = self.known.get(unit)
        if got is None:
            if len(self.known) >= REMEMBERED:
                return self.pieces.cut_drawn(unit, first, further)[1]  # a rare word, worked out once with its skips
            got = self.known[unit] = self._cut(unit, ())
        more, skips = first, ()
        while more < got[0]:
            skips += ((skips[-1] + 1 if skips else 0) + more,)
            got = self._skipping(unit, skips)
            more = next(further)
        return got[1]

    def unit(self, unit: str, place: int, number: int = 0) -> Sequence[int]:
        """Ids of the word at ``place`` of a document."""
        first = self.draws([place], number)
        draws = first, self.again(first)
        return self._occurrence(unit, *(int(self.taken(d)[0]) for d in draws), *(int(d[0]) for d in draws))

    def encode(self, text: str, number: int = 0) -> list[int]:
        """Ids of ``text``; ``number`` tells documents apart."""
        import numpy as np

        if not text:
            return []
        units = self.pieces.units.findall(" " + text)
        first = self.draws(np.arange(len(units)), number)
        draws = first, self.again(first)
        known, once, out = self.known.get, [k.get for k in self.once], []
        # Most words have no skip or one that is remembered.
        for place, (u, first, second) in enumerate(zip(units, *(self.taken(d).tolist() for d in draws), strict=True)):
            got = known(u)
            if got is not None:
                if first < got[0]:
                    got = once[first](u)
                    if got is not None and second < got[0]:
                        got = None
                if got is not None:
                    out += got[1]
                    continue
            out += self._occurrence(u, first, second, int(draws[0][place]), int(draws[1][place]))
        return out


@lru_cache(maxsize=2)
def shared_pieces(path: str | None) -> Pieces:
    """The process's pieces, read once for all its tasks."""
    return Pieces(path)


@lru_cache(maxsize=1)
def shared_encoder(path: str | None, rate: float, seed: int) -> Encoder:
    """The process's encoder: what it remembers serves all its tasks.  It is bounded, and the ids do not hang on it."""
    return Encoder(shared_pieces(path), rate, seed)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = DROPOUT, seed: int = SEED, path: str | None = None) -> DataFrame:
    """``id, ids`` of every row.  Null and empty texts have no ids; equal rows have equal ids; a null id counts as 0."""

    def run(batch):
        import numpy as np
        import pyarrow as pa

        encoder = shared_encoder(path, rate, seed)
        rows = [np.array(encoder.encode(t or "", n or 0), np.int32) for n, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
        return {"id": batch.column(0), "ids": pa.ListArray.from_arrays(ends, np.concatenate([*rows, np.zeros(0, np.int32)]))}

    return per_batch(run, "id bigint, ids array<int>", docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), rows=512)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``id, text`` of every row of ``id, ids``; no ids (or null) give an empty text."""

    def run(batch):
        pieces = shared_pieces(path)
        ids = batch.column("ids")
        flat, ends = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
        return {"id": batch.column("id"), "text": [pieces.decode(flat[a:b].tolist()) for a, b in zip(ends, ends[1:], strict=False)]}

    return per_batch(run, "id bigint, text string", encoded.select("id", F.coalesce("ids", F.expr("CAST(array() AS array<int>)")).alias("ids")), rows=512)


def _crc(encoded: DataFrame) -> DataFrame:
    """Adds number and CRC-32 (little-endian 32-bit ids) of ``ids`` and their decoded text's SHA-256."""

    def run(batch):
        import zlib
        from hashlib import sha256

        import numpy as np

        pieces = shared_pieces(None)
        ids = batch.column("ids")
        flat, ends = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
        rows = [flat[a:b].astype(np.int32) for a, b in zip(ends, ends[1:], strict=False)]
        return {
            "id": batch.column("id"), "n_ids": [len(r) for r in rows], "ids_crc32": [zlib.crc32(r.astype("<u4").tobytes()) for r in rows],
            "decoded_sha256": [sha256(pieces.decode(r.tolist()).encode("utf-8", "replace")).hexdigest() for r in rows],
        }

    return per_batch(run, "id bigint, n_ids bigint, ids_crc32 bigint, decoded_sha256 string", encoded, rows=512)


@query("op7_merge_dropout")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _crc(encode(table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")
