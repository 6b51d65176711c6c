"""Order-preserving packing by dynamic programming.

Texts are encoded and laid end to end in table order.  Cuts are chosen among document ends, sentence ends and a grid
inside long sentences, so that padding plus penalties for cut documents and sentences is least.  The cost of a window
is linear in its length, so the best start of every window is the front of a monotone queue; a half or a quarter
of the length, which need no padding either, are looked up beside it.  No shuffle: each task packs its own split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe_ids import Encoder
from .common import query, sliced, table, utf8

LENGTH, END = 1024, 0
#: Penalties in padding tokens: a cut between sentences of a document, a cut inside a sentence.
CUT_DOCUMENT, CUT_SENTENCE = 4, 10
#: Shorter sequences without padding that are tried: a half, a quarter of the length.
HALVINGS = 2
#: Distance of cut places inside a sentence.
GRID = 16
#: Tokens laid out before the cuts are chosen; a block ends its last sequence.  Bounds memory, not documents.
BLOCK = 1 << 20


def sentence_end_ids(encoder: Encoder):
    """Per id, whether its bytes end a sentence: a stop or a line break last."""
    import numpy as np

    ends = np.zeros(50_257, bool)
    for i in range(50_256):
        ends[i] = encoder.bpe.decode_single_token_bytes(i).rstrip(b"\"')] ").endswith((b".", b"!", b"?", b"\n"))
    return ends


def cut_places(ids, ends, doc_ends):
    """Ascending places after which a sequence may end, and the penalty of each.

    ``doc_ends`` are the ends of documents; the last is the end of ``ids``.
    """
    import numpy as np

    n = len(ids)
    natural = np.flatnonzero(ends[ids]) + 1
    natural = np.union1d(natural, doc_ends)
    starts = np.concatenate([[0], natural[:-1]])
    inner = (natural - starts - 1) // GRID
    base = np.repeat(starts, inner)
    nth = np.arange(len(base)) - np.repeat(np.cumsum(inner) - inner, inner)
    places = np.concatenate([natural, base + GRID * (nth + 1)])
    penalty = np.concatenate([np.full(len(natural), CUT_DOCUMENT), np.full(len(base), CUT_SENTENCE)])
    order = np.argsort(places, kind="stable")
    places, penalty = places[order], penalty[order]
    penalty[np.isin(places, doc_ends)] = 0
    assert places[-1] == n
    return places, penalty


def best_cuts(places: list[int], penalty: list[int], length: int = LENGTH) -> list[int]:
    """Ends of the sequences of least total cost, covering ``0..places[-1]``.

    ``cost(i, j) = padding(places[j] - places[i]) + penalty[j]`` for windows of at most ``length``; no padding at
    ``length`` over a small power of two.  Some place lies in every window, as the grid is finer than the window.
    Ties take the longer window.
    """
    at = [0, *places]
    n = len(at)
    best, came, key = [0] * n, [0] * n, [0] * n  # key = best + place: what padding leaves to compare
    index = dict(zip(at, range(n)))
    halves = [length >> k for k in range(1, HALVINGS + 1)]
    queue = [0] * n  # starts by ascending key; those before head are too far back
    head, tail = 0, 1
    for j in range(1, n):
        here = at[j]
        low = here - length
        i = queue[head]
        while at[i] < low:
            head += 1
            i = queue[head]
        cost = key[i] - low
        if cost > best[i]:  # there is padding to save
            for p in halves:
                k = index.get(here - p)
                if k is not None and best[k] < cost:
                    cost, i = best[k], k
        best[j] = cost = cost + penalty[j - 1]
        came[j] = i
        key[j] = cost = cost + here
        while tail > head and key[queue[tail - 1]] > cost:
            tail -= 1
        queue[tail] = j
        tail += 1
    out, j = [], n - 1
    while j:
        out.append(at[j])
        j = came[j]
    return out[::-1]


PIECE_SCHEMA = "id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids array<int>"


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """Pieces of sequences of at most ``length`` tokens: ``id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, ids`` (null unless ``with_ids``).

    A null or empty text is its end id alone; repeated rows are packed each; an empty table gives an empty result.
    ``length`` is a power of two over ``GRID``.  Sequence numbers hold the task's number above the sequence's own, so
    they are unique and a repeated task gives the same.
    """
    if length <= GRID or length & (length - 1):
        raise ValueError("length has to be a power of two above the grid")
    spec = PIECE_SCHEMA

    def run(batches):
        import zlib

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        encoder = Encoder(path)
        ends = sentence_end_ids(encoder)
        numbers = iter(range(TaskContext.get().partitionId() << 40, 1 << 62))
        types = [pa.int64()] * 7 + [pa.list_(pa.int32())]
        names = [x.split()[0] for x in spec.split(", ")]
        held: list = []
        size = 0

        def packed():
            """Packs what is held: whole documents or, of a long one, a stretch of it."""
            nonlocal held, size
            ids = np.concatenate([x[3] for x in held])
            stops = np.cumsum([len(x[3]) for x in held])
            finished = [x[1] + len(x[3]) == x[2] for x in held]
            places, penalty = cut_places(ids, ends, stops)
            penalty[np.isin(places, stops[~np.array(finished)])] = CUT_SENTENCE
            cuts = best_cuts(places.tolist(), penalty.tolist(), length)
            rows = []
            k = start = 0
            for cut in cuts:
                number, offset = next(numbers), 0
                while start < cut:
                    doc, before, total, own = held[k]
                    first = int(stops[k]) - len(own)
                    end = min(cut, int(stops[k]))
                    piece = ids[start:end]
                    rows.append((doc, before + start - first, end - start, zlib.crc32(piece.astype("<u4").tobytes()), total, number, offset, piece.astype(np.int32) if with_ids else None))
                    offset += end - start
                    start = end
                    k += start == stops[k]
            held, size = [], 0
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        for batch in sliced(batches):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encoder.encode(text.decode("utf-8", "replace")), np.uint32(END))
                for a in range(0, len(ids), BLOCK):
                    part = ids[a : a + BLOCK]
                    held.append((doc, a, len(ids), part))
                    size += len(part)
                    if size >= BLOCK:
                        yield packed()
        if held:
            yield packed()

    return docs.select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("text")).mapInArrow(run, spec)


@query("op4_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), with_ids=False).drop("ids").withColumnRenamed("id", "doc_id")
