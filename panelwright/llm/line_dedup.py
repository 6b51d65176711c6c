"""Line dedup by a segment-partition edit join.

Two lines within ``tau`` edits: cut the shorter one into ``tau + 1`` segments, and at least one stands unchanged in the
longer one, near its own place.  Every distinct line is indexed by its segments and probes the few substrings at which
a segment of a line of its length, or up to ``tau`` shorter, can stand.  Keys are 64-bit hashes of (length, segment
number, characters), taken for a whole batch from prefix sums.  Pairs that share a key and whose character parities
allow ``tau`` edits are verified with a banded bit-parallel edit distance.  Linked lines form classes, which are named by their first line in the corpus.  Where lines
are dropped, a chain of links is not enough: each that goes has a line that stays within ``tau`` edits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, numbered, per_batch, query, sliced, table, utf8
from .graph import components

#: Edits that two lines of a class may be apart, and the code points below which lines are left alone unless asked for.
TAU, MIN_CHARS = 2, 24
#: Where shorter lines take part: from so many code points with one edit, below that as exact repeats only.
ONE_EDIT_CHARS = 12
#: Cells of the character matrix that one verification step holds.
CELLS = 1 << 22
#: Bytes of lines whose keys are taken at a time, code points whose signatures are, and most line ids that are sent to every
#: task.  Arrays of this size stay in the cache and in memory that the process has; larger ones cost twice the time.
PARCEL, SIGNED, SENT_IDS = 1 << 17, 1 << 15, 2_000_000
#: Rounds in which earlier lines come before later ones when lines are dropped; a long chain's rest goes by hash, which
#: takes a number of rounds that grows with the logarithm of its length.
ORDERED_ROUNDS = 3


def segments(length: int, tau: int = TAU) -> list[tuple[int, int]]:
    """Start and size of the ``tau + 1`` segments of a line of ``length``, sizes differing by one at most."""
    small, more = divmod(length, tau + 1)
    out, at = [], 0
    for i in range(tau + 1):
        size = small + (i >= tau + 1 - more)
        out.append((at, size))
        at += size
    return out


def probe_starts(start: int, i: int, delta: int, tau: int = TAU) -> range:
    """Where segment ``i`` (from 0) of a line ``delta`` shorter can stand, if it is the one to be found: left of it lie
    at most ``i`` edits, right of it at most ``tau - i``."""
    return range(max(start - i, start + delta - (tau - i)), min(start + i, start + delta + (tau - i)) + 1)


def segment_keys(texts: list[str], probe: bool, tau: int = TAU):
    """``number, key`` of the index rows or of the probe rows for a list of lines, as two arrays."""
    import numpy as np

    length = np.array([len(t) for t in texts], np.int64)
    begin = np.concatenate([[0], np.cumsum(length)[:-1]])
    chars = code_points("".join(texts)).astype(np.uint64)
    base = 0x9E3779B97F4A7C15
    inverse = pow(base, -1, 1 << 64)
    mixed = (chars + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(31)
    one = np.ones(1, np.uint64)
    power = np.cumprod(np.concatenate([one, np.full(len(chars), base, np.uint64)]))
    back = np.cumprod(np.concatenate([one, np.full(len(chars), inverse, np.uint64)]))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed * power[:-1])])

    def keys(at, size, of_length, i: int):
        h = (total[at + size] - total[at]) * back[at]
        h ^= (of_length.astype(np.uint64) * np.uint64(8) + np.uint64(i)) * np.uint64(0x94D049BB133111EB)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        return h.view(np.int64)

    def place(i: int, of_length):
        """Segment ``i`` of lines of ``of_length``, as in segments()."""
        small, more = np.divmod(of_length, tau + 1)
        return i * small + np.maximum(i - (tau + 1 - more), 0), small + (i >= tau + 1 - more)

    number, out = np.arange(len(texts)), []
    for i in range(tau + 1):
        for delta in range(tau + 1) if probe else (0,):
            start, size = place(i, length - delta)
            for shift in probe_starts(0, i, delta, tau) if probe else (0,):
                at = start + shift
                ok = (at >= 0) & (at + size <= length) & (length - delta > 0)
                out.append((number[ok], keys((begin + at)[ok], size[ok], (length - delta)[ok], i)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def code_points(text: str):
    import numpy as np

    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def signatures(texts: list[str]):
    """Parities of hashed characters (low 32 bits) and of hashed pairs of neighbours (high 32 bits) of each line.

    An edit changes at most 2 characters and 4 pairs of the line's multisets, each of which flips one bit.
    """
    import numpy as np

    out, own, size = [], [], 0
    for t in texts:
        own.append(t)
        size += len(t)
        if size >= SIGNED:
            out.append(_signatures(own))
            own, size = [], 0
    if own:
        out.append(_signatures(own))
    return np.concatenate([*out, np.zeros(0, np.int64)])


def _signatures(texts: list[str]):
    import numpy as np

    length = np.array([len(t) for t in texts], np.int64)
    begin = np.concatenate([[0], np.cumsum(length)[:-1]])
    chars = code_points("".join(texts)).astype(np.uint64)
    one, mul = np.uint64(1), np.uint64(0x9E3779B97F4A7C15)
    bits = one << (chars * mul >> np.uint64(59))
    pairs = one << (np.uint64(32) + ((chars[:-1] * mul ^ chars[1:]) * mul >> np.uint64(59)))
    pairs = np.append(pairs, np.uint64(0))
    pairs[begin[1:] - 1] = 0  # no pair reaches into the next line
    return np.bitwise_xor.reduceat(bits ^ pairs, begin).view(np.int64)


def within_edits(left: list[str], right: list[str], tau: int = TAU):
    """Edit distance of each pair, ``tau + 1`` where it is more than ``tau``.

    One machine word per pair holds the band of the distance matrix around the diagonal (bit 63: the lowest cell) as
    vertical differences; a step advances all pairs by one column.  Pairs differ in length by at most ``tau``.
    """
    import numpy as np

    out = np.full(len(left), tau + 1)
    longer = [a if len(a) >= len(b) else b for a, b in zip(left, right, strict=True)]
    shorter = [b if len(a) >= len(b) else a for a, b in zip(left, right, strict=True)]
    order = sorted(range(len(left)), key=lambda k: len(longer[k]))
    while order:
        widest = len(longer[order[-1]]) + 2 * tau + 1
        now, order = order[-max(1, CELLS // widest):], order[: -max(1, CELLS // widest)]
        out[now] = _banded([longer[k] for k in now], [shorter[k] for k in now], tau)
    return out


def _matrix(texts: list[str], pad_left: int, pad_right: int, fill: int):
    import numpy as np

    width = max(map(len, texts)) + pad_left + pad_right
    m = np.full((len(texts), width), fill, np.uint32)
    for row, t in zip(m, texts, strict=True):
        row[pad_left : pad_left + len(t)] = code_points(t)
    return m


def _banded(a: list[str], b: list[str], tau: int):
    """Distances of lists with ``len(a[k]) >= len(b[k])``."""
    import numpy as np

    none = 0xFFFFFFFF
    u = np.uint64
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    ma, mb = _matrix(a, tau, tau + 1, none), _matrix(b, 0, 1, none - 1)
    full = u(0xFFFFFFFFFFFFFFFF)
    vp = np.full(len(a), full << u(63 - tau), u)
    vn = np.zeros(len(a), u)
    dist = np.minimum(la, tau)  # the last row, where the band is longer than the line
    for j in range(int(lb.max(initial=0))):
        match = np.zeros(len(a), u)
        for k in range(2 * tau + 1):  # bit 63 - k stands for a[j + tau - k]
            at = j + 2 * tau - k
            if at < ma.shape[1]:
                match |= (ma[:, at] == mb[:, j]).astype(u) << u(63 - k)
        d0 = (((match & vp) + vp) ^ vp) | match | vn
        hp = vn | ~(d0 | vp)
        hn = d0 & vp
        # Along the band's lowest diagonal while it lies inside the matrix, then along its last row.
        down = j < la - tau
        row = np.where(down, 0, 62 - (j - (la - tau))).astype(np.int64) & 63
        along = ((hp >> row.astype(u)) & u(1)).astype(int) - ((hn >> row.astype(u)) & u(1)).astype(int)
        step = np.where(down, 1 - (d0 >> u(63)).astype(int), along)
        dist += np.where(j < lb, step, 0)
        vp = hn | ~((d0 >> u(1)) | hp)
        vn = (d0 >> u(1)) & hp
    # Without any column the distance is the other length.
    dist = np.where(lb == 0, la, dist)
    return np.minimum(dist, tau + 1)


def lines_of(text: bytes) -> list[bytes]:
    return text.split(b"\n")


def known_lines(text: bytes, least: int) -> list[tuple[int, bytes]]:
    """Number and stripped bytes of the lines that take part: those of at least ``least`` code points."""
    out = []
    for i, line in enumerate(lines_of(text)):
        line = line.strip()
        if len(line) >= least and (len(line) >= 4 * least or len(line.decode("utf-8", "replace")) >= least):
            out.append((i, line))
    return out


def digest(line: bytes) -> bytes:
    from hashlib import blake2b

    return blake2b(line, digest_size=16).digest()


def occurrences(docs: DataFrame, least: int) -> DataFrame:
    """``__row, id, line, h``: places of all lines that take part."""

    def run(batch):
        rows = []
        for row, doc, text in zip(*(batch.column(c).to_pylist() for c in ("__row", "id", "text")), strict=True):
            rows += [(row, doc, i, digest(x)) for i, x in known_lines(text, least)]
        return dict(zip(("__row", "id", "line", "h"), zip(*rows), strict=True)) if rows else {"__row": [], "id": [], "line": [], "h": []}

    return per_batch(run, "__row bigint, id bigint, line int, h binary", docs)


def parcels(texts: list[bytes], least: int, most: int | None = None):
    """The different lines of some texts, of at most ``most`` code points, as ``bytes`` lists of about ``PARCEL`` bytes
    each."""
    own, size = [], 0
    for line in {x for text in texts for _, x in known_lines(text, least)}:
        if most is not None and (len(line) > 4 * most or len(line.decode("utf-8", "replace")) > most):
            continue
        own.append(line)
        size += len(line)
        if size >= PARCEL:
            yield own
            own, size = [], 0
    if own:
        yield own


def short_id(h: bytes) -> int:
    return int.from_bytes(h[:8], "little", signed=True)


def key_rows(docs: DataFrame, probe: bool, tau: int, least: int, most: int | None = None) -> DataFrame:
    """Index or probe rows ``n, key, sig`` of all lines; ``n`` is the front of the line's digest.

    A line comes once per batch that has it.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in sliced(batches, 4096):
            for own in parcels(batch.column("text").to_pylist(), least, most):
                texts = [x.decode("utf-8", "replace") for x in own]
                at, key = segment_keys(texts, probe, tau)
                n, sig = np.array([short_id(digest(x)) for x in own]), signatures(texts)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (n[at], key, sig[at])], ["n", "key", "sig"])

    return docs.select("text").mapInArrow(run, "n bigint, key bigint, sig bigint")


def line_texts(docs: DataFrame, ids: DataFrame, least: int, most: int | None = None) -> DataFrame:
    """``n, h, line`` of the lines whose ``n`` is in ``ids``, each once."""

    def run(batches):
        import pyarrow as pa

        for batch in sliced(batches, 4096):
            for own in parcels(batch.column("text").to_pylist(), least, most):
                h = list(map(digest, own))
                yield pa.RecordBatch.from_arrays([pa.array(list(map(short_id, h)), pa.int64()), pa.array(h, pa.binary()), pa.array(own, pa.binary())], ["n", "h", "line"])

    # A list of ids goes to every task while it is small; beyond that the lines are dealt by id.
    few = ids if ids.count() > SENT_IDS else F.broadcast(ids)
    found = docs.select("text").mapInArrow(run, "n bigint, h binary, line binary").join(few, "n", "left_semi")
    return found.groupBy("n", "h").agg(F.min("line").alias("line"))


def edit_links(docs: DataFrame, tau: int = TAU, least: int = MIN_CHARS, below: int | None = None) -> DataFrame:
    """``a, b``: digests of all pairs of different lines of ``docs`` (``text``: bytes) within ``tau`` edits, each pair
    once, ``a > b``; with ``below`` those whose shorter line has fewer code points than that."""
    most = None if below is None else below - 1 + tau
    x, y = key_rows(docs, False, tau, least, most).alias("x"), key_rows(docs, True, tau, least, most).alias("y")
    apart = F.col("x.sig").bitwiseXOR(F.col("y.sig"))
    near = (F.bit_count(apart.bitwiseAND(F.lit(0xFFFFFFFF))) <= 2 * tau) & (F.bit_count(F.shiftrightunsigned(apart, 32)) <= 4 * tau)
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.n") != F.col("y.n")) & near)
    pairs = materialize(pairs.select(F.greatest("x.n", "y.n").alias("a"), F.least("x.n", "y.n").alias("b")).distinct(), "line-candidates")
    ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("n")).distinct(), "candidate-ids")
    texts = materialize(line_texts(docs, ids, least, most), "candidate-lines")

    def run(batch):
        import numpy as np

        left, right = ([x.decode("utf-8", "replace") for x in batch.column(c).to_pylist()] for c in ("left", "right"))
        ok = within_edits(left, right, tau) <= tau if left else np.zeros(0, bool)
        if below is not None:
            ok &= np.array([min(len(a), len(b)) < below for a, b in zip(left, right, strict=True)], bool)
        each = zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), ok, strict=True)
        links = [(max(a, b), min(a, b)) for a, b, k in each if k]
        return {"a": [a for a, _ in links], "b": [b for _, b in links]}

    side = lambda k, h, name: texts.select(F.col("n").alias(k), F.col("h").alias(h), F.col("line").alias(name))
    both = pairs.join(side("a", "x", "left"), "a").join(side("b", "y", "right"), "b").select("x", "y", "left", "right")
    return per_batch(run, "a binary, b binary", both, rows=2048)


def line_tables(docs: DataFrame, id_col: str, text_col: str, tau: int, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All places of lines, the links between different lines, and ``h, first, n``: each line's first place and count."""
    texts = docs.select("__row", F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("text"))
    places = materialize(occurrences(texts, least), "line-places")
    links = edit_links(texts, tau, max(least, MIN_CHARS))
    if least < MIN_CHARS:
        # Pairs whose shorter line is short; a pair's edits go by its shorter line.
        links = links.unionByName(edit_links(texts, 1, max(least, ONE_EDIT_CHARS), MIN_CHARS))
    links = materialize(links, "line-links")
    first = places.groupBy("h").agg(F.min(F.struct("id", F.col("__row").alias("row"), "line")).alias("first"), F.count(F.lit(1)).alias("n"))
    return places, links, first


def line_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = TAU, least: int = MIN_CHARS) -> DataFrame:
    """``__row, id, line, first_row, first_id, first_line, n_links, kept`` for every line that takes part.

    Lines are compared without white space around them.  Where ``least`` is below ``MIN_CHARS``, a pair whose shorter
    line has fewer code points than that is linked by one edit from ``ONE_EDIT_CHARS`` on and not at all below; equal
    lines are one line at any length.  ``__row`` numbers the rows of ``docs``, which has to have
    that column.  The class of a line is everything that links of at most ``tau`` edits reach; its first line by
    (id, row, line) stays.  ``n_links`` counts the different lines within ``tau`` edits.
    """
    places, links, first = line_tables(docs, id_col, text_col, tau, least)
    roots = components(links).select(F.col("a").alias("h"), F.col("b").alias("root"))
    degree = links.select(F.explode(F.array("a", "b")).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n_links"))
    linked = materialize(degree.join(roots, "h", "left").select("h", F.coalesce("root", "h").alias("root"), "n_links"), "linked-lines")
    known = first.join(linked, "h", "left").filter((F.col("n") > 1) | F.col("root").isNotNull())
    known = materialize(known.select("h", "first", F.coalesce("root", "h").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "repeated-lines")
    best = known.groupBy("root").agg(F.min("first").alias("best"))
    # Written, so that the places of a very common line can be split among tasks.  All other lines are alone.
    named = materialize(known.join(best, "root").select("h", F.col("best").alias("first"), "n_links"), "line-classes")
    out = places.join(named, "h", "left")
    place = F.coalesce("first", F.struct("id", F.col("__row").alias("row"), "line"))
    return out.select(
        "__row", "id", "line", place["row"].alias("first_row"), place["id"].alias("first_id"), place["line"].alias("first_line"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        ((place["row"] == F.col("__row")) & (place["line"] == F.col("line"))).alias("kept"),
    )


def covered_lines(links: DataFrame, first: DataFrame) -> DataFrame:
    """``h`` of the lines that go: each has a link to a line that stays, and no two lines that stay are linked.

    A maximal independent set.  In every round the lines that come before all their undecided neighbours stay and those
    neighbours go; a line without undecided neighbours stays.
    """
    place = first.select(F.col("h").alias("a"), F.col("first").alias("p"))
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = both.join(place, "a").join(place.select(F.col("a").alias("b"), F.col("p").alias("q")), "b").select("a", "b", "p", "q")
    open_, gone, step = materialize(both, "open-links"), None, 0
    while not open_.isEmpty():
        if step < ORDERED_ROUNDS:
            own, other = F.col("p"), F.col("q")
        else:
            own, other = (F.struct(F.xxhash64(c, F.lit(step)).alias("x"), F.col(c).alias("h")) for c in ("a", "b"))
        stay = open_.select("a", own.alias("own"), other.alias("other")).groupBy("a").agg(F.first("own").alias("own"), F.min("other").alias("other"))
        stay = materialize(stay.filter(F.col("own") < F.col("other")).select("a"), "staying-lines")
        now = materialize(open_.join(stay, "a", "left_semi").select(F.col("b").alias("h")).distinct(), "covered-lines")
        gone = now if gone is None else gone.unionByName(now)
        done = stay.select(F.col("a").alias("h")).unionByName(now)
        left = open_.join(done, open_["a"] == done["h"], "left_anti").join(done.select(F.col("h").alias("b")), "b", "left_anti")
        open_, step = materialize(left.select("a", "b", "p", "q"), "open-links"), step + 1
    return first.select("h").limit(0) if gone is None else gone


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = TAU, least: int = MIN_CHARS) -> DataFrame:
    """``docs`` with the same columns, without the lines that equal a line that stays or are within ``tau`` edits of it;
    rows of which nothing but white space would be left go, unless nothing was there before (null and empty texts stay).
    """
    names = docs.columns
    rows = numbered(docs)
    places, links, first = line_tables(rows, id_col, text_col, tau, least)
    covered = covered_lines(links, first).withColumn("covered", F.lit(True))
    known = first.join(covered, "h", "left").filter((F.col("n") > 1) | F.col("covered"))
    # Written, so that the places of a very common line can be split among tasks.
    known = materialize(known.select("h", "first", F.coalesce("covered", F.lit(False)).alias("covered")), "repeated-lines")
    at_first = (F.col("first.row") == F.col("__row")) & (F.col("first.line") == F.col("line"))
    gone = places.join(known, "h").filter(F.col("covered") | ~at_first).select("__row", "line")
    # A row's lines are bounded by its text.
    gone = gone.groupBy("__row").agg(F.collect_list("line").alias("__gone"))
    where = names.index(text_col)

    def run(batches):
        import pyarrow as pa

        for batch in sliced(batches):
            texts, keep = [], []
            for text, drop in zip(batch.column(text_col).to_pylist(), batch.column("__gone").to_pylist(), strict=True):
                if drop:
                    out = set(drop)
                    text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in out)
                keep.append(not drop or bool(text.strip()))
                texts.append(text)
            columns = [batch.column(c) for c in names]
            columns[where] = pa.array(texts, columns[where].type)
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(keep, pa.bool_()))

    return rows.join(gone, "__row", "left").select(*names, "__gone").mapInArrow(run, docs.schema)


@query("op9_line_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = numbered(table(spark, sf_dir, "documents"))
    out = line_classes(docs, least=1)
    return out.select(F.col("id").alias("doc_id"), "line", F.col("first_id").alias("class_doc"), F.col("first_line").alias("class_line"), "n_links", "kept")
