"""SimHash near-dedup by the general pigeonhole principle.

Fingerprints are dealt into partitions of bits, correlated bits together.  If partition ``i`` is searched within
``t[i]`` differing bits and the sum of ``t[i] + 1`` is over the threshold, no pair within the threshold is missed.  The
``t[i]`` are chosen by dynamic programming on candidate counts estimated from all fingerprints; partitions are then
probed and pairs verified on all 64 bits inside the join.  Equal fingerprints are one row throughout.

Near duplicates of whole texts are found by prefixes instead, whose number goes with the text and not with the pairs that
many short keys make: in any common order of shingles, two sets with a Jaccard similarity of ``J`` share one of the first
``n - ceil(J * n) + 1`` of each.  The fingerprints filter the pairs that share one.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations, islice
from math import comb

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import unbroadcast
from .common import keyed, materialize, numbered, per_batch, query, table, utf8
from .graph import components

BITS = 64
SHINGLE, DISTANCE, SEED = 3, 3, 42
#: Numbers of partitions that are tried, and the cost of one probing row in verified candidates.
PARTITIONS, PROBE_COST = (2, 3, 4), 4.0
#: Buckets of more fingerprints than this are compared in blocks, which give a spanning forest in place of all pairs.
LARGE_BUCKET, BLOCK = 128, 1024
#: Near duplicates of whole texts: candidates are fingerprints over different pairs of words within so many bits, of which
#: those stay whose sets of five-word shingles have this Jaccard similarity.
SIMILAR_WIDTH, SIMILAR_DISTANCE, SIMILAR_PARTITIONS = 2, 8, (3, 4, 5, 6, 8)
JACCARD_WIDTH, JACCARD = 5, 0.8
#: Shingles that come last in the order of prefixes: the most frequent ones, so many at most, of those that this many texts
#: of every so many have.  Only the order hangs on them, not which pairs are found.
COMMON, COMMON_TEXTS, COMMON_OF = 1 << 20, 4, 16
#: Texts that may share a shingle of their prefixes, in large buckets of fingerprints, before fingerprints are searched instead.
SHARED = 4
#: As LARGE_BUCKET and BLOCK, where whole shingle sets are compared.
SIMILAR_BUCKET, SIMILAR_BLOCK = 64, 256
#: Most row numbers that are sent to every task, and shingles of a block that are compared at a time.
SENT_IDS, COLUMNS = 2_000_000, 4096
#: Hashes whose bits are counted at a time.
AT_A_TIME = 1 << 16


def shingle_digests(text: bytes, width: int):
    """XXH64 of every word shingle, repeats included, one after the other; of the whole sequence if it has fewer words."""
    import xxhash

    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    digest = xxhash.xxh64_intdigest
    if len(words) >= width:
        return (digest(b" ".join(w), SEED) for w in zip(*(islice(words, k, None) for k in range(width))))
    return iter([digest(b" ".join(words), SEED)] if words else [])


def shingle_hashes(text: bytes, width: int) -> list[int]:
    return list(shingle_digests(text, width))


def majority(hashes) -> int:
    """The bits that are set in over half of the hashes, as a signed integer; zero without hashes.

    The hashes are taken ``AT_A_TIME``, so that a long text is never held as a byte per bit.
    """
    import numpy as np

    hashes, n, ones = iter(hashes), 0, np.zeros(BITS, np.int64)
    while some := list(islice(hashes, AT_A_TIME)):
        n += len(some)
        ones += np.unpackbits(np.array(some, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    return majority(shingle_digests(text, width))


def fingerprint_of_set(text: bytes, width: int = SIMILAR_WIDTH) -> int:
    """The fingerprint over different shingles, each once."""
    return majority(set(shingle_digests(text, width)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", of=fingerprint) -> DataFrame:
    """``id, fp`` of every row; ``of(text)`` is the fingerprint."""

    def run(batch):
        return {"id": batch.column(0), "fp": [of(t) for t in batch.column(1).to_pylist()]}

    return per_batch(run, "id bigint, fp bigint", docs.select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("text")))


def signed(bits) -> int:
    """The 64-bit literal with these bits set."""
    x = sum(1 << b for b in bits)
    return x - (1 << 64) if x >> 63 else x


def bit_counts(distinct: DataFrame):
    """How many fingerprints have bits ``i`` and ``j`` set, as a matrix: 64 x 64 numbers from all fingerprints."""
    import numpy as np

    def run(batch):
        x = np.unpackbits(batch.column(0).to_numpy(zero_copy_only=False).astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
        both = (x.T @ x).astype(np.int64)
        i, j = np.triu_indices(BITS)
        return {"i": i, "j": j, "n": both[i, j]}

    rows = per_batch(run, "i int, j int, n bigint", distinct.select("fp")).groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    out = np.zeros((BITS, BITS))
    for r in rows:
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["n"]
    return out


def group_bits(both, n: int, parts: int) -> list[list[int]]:
    """Partitions of nearly equal size, each grown from the least balanced bit left by the bits most correlated with it."""
    import numpy as np

    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    left, out = set(range(BITS)), []
    for k in range(parts):
        size = (BITS - sum(map(len, out))) // (parts - k)
        group = [max(sorted(left), key=lambda b: abs(p[b] - 0.5))]
        left.discard(group[0])
        while len(group) < size:
            b = max(sorted(left), key=lambda b: corr[b, group].sum())
            group.append(b)
            left.discard(b)
        out.append(sorted(group))
    return out


def within(p, most: int) -> list[float]:
    """Chance that two fingerprints differ in exactly 0..``most`` bits, if bits with set shares ``p`` are independent."""
    chance = [1.0] + [0.0] * most
    for q in (2 * x * (1 - x) for x in p):
        chance = [c * (1 - q) + (chance[k - 1] * q if k else 0.0) for k, c in enumerate(chance)]
    return chance


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds ``t`` of least summed cost with ``sum(t[i] + 1) == total``; ``costs[i][t + 1]``, -1 leaves ``i`` out."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, t) in best.items():
            for more in range(min(len(own), total - used + 1)):
                new = (cost + own[more], [*t, more - 1])
                if used + more not in step or new < step[used + more]:
                    step[used + more] = new
        best = step
    return best[total]


def plan_partitions(distinct: DataFrame, distance: int = DISTANCE, tries=PARTITIONS) -> list[tuple[list[int], int]]:
    """Bits and threshold of each partition that is searched, of the cheapest plan.

    Candidates without a differing bit are counted over all fingerprints, one aggregation per partition; further ones
    are scaled up from them by the chances of independent bits.
    """
    n = distinct.count()
    both = bit_counts(distinct)
    plans = [group_bits(both, n, m) for m in tries if m <= distance + 1]
    groups = [g for plan in plans for g in plan]
    sizes = reduce(DataFrame.union, (
        distinct.groupBy(F.col("fp").bitwiseAND(F.lit(signed(g))).alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("k"), "n")
        for k, g in enumerate(groups)
    ))
    pairs = {r["k"]: r["pairs"] for r in sizes.groupBy("k").agg(F.sum(F.col("n").cast("double") * (F.col("n") - 1) / 2).alias("pairs")).collect()}
    best = None
    k = 0
    for plan in plans:
        costs = []
        for g in plan:
            chance = within([both[b, b] / max(n, 1) for b in g], distance)
            found = [pairs.get(k, 0.0) + n * float(n) / 2 * sum(chance[1 : t + 1]) for t in range(distance + 1)]
            probes = [sum(comb(len(g), d) for d in range(t + 1)) for t in range(distance + 1)]
            costs.append([0.0, *(c + PROBE_COST * n * (1 + p) for c, p in zip(found, probes, strict=True))])
            k += 1
        cost, t = allocate(costs, distance + 1)
        if best is None or cost < best[0]:
            best = (cost, [(g, x) for g, x in zip(plan, t, strict=True) if x >= 0])
    return best[1]


def differing(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _index(distinct: DataFrame, plan) -> DataFrame:
    parts = F.array(*(F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(signed(g))).alias("key")) for i, (g, _) in enumerate(plan)))
    return distinct.select("fp", F.explode(parts).alias("p")).select("fp", "p.part", "p.key")


def _probes(distinct: DataFrame, plan) -> DataFrame:
    """Every value within a partition's threshold of the fingerprint's own."""

    def near(i: int, bits: list[int], t: int) -> Column:
        own = F.col("fp").bitwiseAND(F.lit(signed(bits)))
        flips = [signed(c) for d in range(t + 1) for c in combinations(bits, d)]
        return F.transform(F.array(*map(F.lit, flips)), lambda x: F.struct(F.lit(i).alias("part"), own.bitwiseXOR(x).alias("key")))

    all_near = F.concat(*(near(i, g, t) for i, (g, t) in enumerate(plan)))
    return distinct.select("fp", F.explode(all_near).alias("p")).select("fp", "p.part", "p.key")


def forest(a, b, near):
    """Edges that connect what the pairs of ``near`` (a matrix over ``a`` x ``b``) connect: every value with the smallest
    one of its component."""
    import numpy as np

    values = np.unique(np.concatenate([a, b]))
    ia, ib = np.searchsorted(values, a), np.searchsorted(values, b)
    label = np.arange(len(values))
    while True:
        new = label.copy()
        rows = np.where(near, label[ib][None, :], len(values)).min(1, initial=len(values))
        np.minimum.at(new, ia, rows)
        cols = np.where(near, new[ia][:, None], len(values)).min(0, initial=len(values))
        np.minimum.at(new, ib, cols)
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(values))
    return values[moved], values[label[moved]]


def within_bits(a, b, distance: int):
    """Which pairs of ``a`` x ``b`` differ in ``distance`` bits at most."""
    import numpy as np

    return np.bitwise_count((a[:, None] ^ b[None, :]).view(np.uint64)) <= distance  # of signed numbers it would count the magnitude's bits


def jaccard_matrix(left: list, right: list):
    """Jaccard similarity of every pair of two lists of sorted integer sets.

    Shared members are counted by products of membership matrices, ``COLUMNS`` members at a time.
    """
    import numpy as np

    sizes = [np.array([len(x) for x in side], float) for side in (left, right)]
    flat = [np.concatenate([*side, np.zeros(0, np.int64)]) for side in (left, right)]
    owner = [np.repeat(np.arange(len(side)), n.astype(int)) for side, n in zip((left, right), sizes, strict=True)]
    both = np.intersect1d(*flat)
    shared = np.zeros((len(left), len(right)))
    for at in range(0, len(both), COLUMNS):
        part = both[at : at + COLUMNS]
        has = []
        for values, own, side in zip(flat, owner, (left, right), strict=True):
            col = np.minimum(np.searchsorted(part, values), len(part) - 1)
            hit = part[col] == values
            m = np.zeros((len(side), len(part)), np.float32)
            m[own[hit], col[hit]] = 1
            has.append(m)
        shared += has[0] @ has[1].T
    union = sizes[0][:, None] + sizes[1][None, :] - shared
    return np.where(union > 0, shared / np.maximum(union, 1), 1.0)


def large_bucket_edges(index: DataFrame, probes: DataFrame, large: DataFrame, distance: int, sets: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """Edges within the buckets of ``large`` (``part, key, n``): pairs of blocks, of bounded size, are compared in one
    task each, which gives at most one edge per member.  With ``sets`` (``fp, shingles``) pairs also have to be alike
    in their shingles."""
    import numpy as np

    alike = sets is not None

    def dealt(df: DataFrame, side: str, mine: str, other: str) -> DataFrame:
        rows = df.join(large, ["part", "key"]).withColumn(mine, F.pmod(F.xxhash64("fp"), F.col(f"{mine}_blocks")))
        rows = rows.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{other}_blocks") - 1))).select("part", "key", "i", "j", F.lit(side).alias("side"), "fp")
        return rows.join(sets, "fp") if alike else rows

    def compare(group):
        import pyarrow as pa

        fp = group.column("fp").to_numpy().astype(np.int64)
        is_index = np.array([s == "i" for s in group.column("side").to_pylist()], bool)
        a, b = fp[is_index], fp[~is_index]
        near = within_bits(a, b, distance)
        if alike and near.any():
            own = [np.asarray(x, np.int64) for x in group.column("shingles").to_pylist()]
            near &= jaccard_matrix([x for x, i in zip(own, is_index, strict=True) if i], [x for x, i in zip(own, is_index, strict=True) if not i]) >= JACCARD
        edges = forest(a, b, near)
        return pa.table({"a": edges[0].astype(np.int64), "b": edges[1].astype(np.int64)})

    n_probes = probes.join(large, ["part", "key"], "left_semi").groupBy("part", "key").agg(F.count(F.lit(1)).alias("p"))
    large = large.join(n_probes, ["part", "key"]).select("part", "key", F.ceil(F.col("n") / block).cast("long").alias("i_blocks"), F.ceil(F.col("p") / block).cast("long").alias("j_blocks"))
    rows = dealt(index, "i", "i", "j").unionByName(dealt(probes, "p", "j", "i"))
    return rows.groupBy("part", "key", "i", "j").applyInArrow(compare, "a bigint, b bigint")


def buckets(distinct: DataFrame, plan, distance: int, large_bucket: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """``index, probes, links, large``: links ``a, b`` of all pairs within ``distance`` in buckets of moderate size, and
    the buckets that are larger (None without any)."""
    index, probes = _index(distinct, plan), _probes(distinct, plan)
    sizes = index.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n"))
    large = materialize(sizes.filter(F.col("n") > large_bucket), "large-buckets")
    some = not large.isEmpty()
    few = [x.join(large, ["part", "key"], "left_anti") if some else x for x in (index, probes)]
    i, p = few[0].alias("i"), few[1].alias("p")
    same = (F.col("i.part") == F.col("p.part")) & (F.col("i.key") == F.col("p.key"))
    near = (F.col("i.fp") < F.col("p.fp")) & (differing(F.col("i.fp"), F.col("p.fp")) <= distance)
    return index, probes, i.join(p, same & near).select(F.col("p.fp").alias("a"), F.col("i.fp").alias("b")), large if some else None


def near_links(distinct: DataFrame, plan, distance: int = DISTANCE, large_bucket: int = LARGE_BUCKET) -> DataFrame:
    """``a, b``: links between fingerprints, enough of them to connect all that lie within ``distance``."""
    index, probes, links, large = buckets(distinct, plan, distance, large_bucket)
    return links if large is None else links.unionByName(large_bucket_edges(index, probes, large, distance))


def shingle_sets(docs: DataFrame, rows: DataFrame, text_col: str, width: int) -> DataFrame:
    """``first, shingles``: sorted different shingle hashes of the texts of ``docs`` whose ``__row`` is in ``rows``."""

    def run(batch):
        hashes = [sorted(x - (1 << 64) if x >> 63 else x for x in set(shingle_hashes(t, width))) for t in batch.column(1).to_pylist()]
        return {"first": batch.column(0), "shingles": hashes}

    # A list of row numbers goes to every task while it is small; beyond that the texts are dealt by number.
    few = rows if rows.count() > SENT_IDS else F.broadcast(rows)
    own = docs.select(F.col("__row").alias("first"), utf8(text_col).alias("text")).join(few, "first", "left_semi")
    return per_batch(run, "first bigint, shingles array<bigint>", own, rows=2048)


def prefix(hashes, common):
    """The shingles of a text by one of which every text with a Jaccard similarity of ``JACCARD`` is found; those of the
    sorted ``common`` ones come last in the order."""
    import numpy as np

    own = np.unique(np.fromiter(hashes, np.uint64)).view(np.int64)
    if len(common):
        often = common[np.minimum(np.searchsorted(common, own), len(common) - 1)] == own
        own = np.concatenate([own[~often], own[often]])
    return own[: len(own) - math.ceil(JACCARD * len(own) - 1e-9) + 1] if len(own) else own


def common_shingles(docs: DataFrame, text_col: str, most: int = COMMON):
    """The most frequent shingles, sorted, ``most`` at most: all above a frequency that a histogram of logarithmic classes
    (a few hundred rows) tells, counted in one of ``COMMON_OF`` texts by row number."""
    import numpy as np

    def run(batch):
        own = [np.unique(np.fromiter(shingle_digests(t, JACCARD_WIDTH), np.uint64)) for t in batch.column(0).to_pylist()]
        values, n = np.unique(np.concatenate([*own, np.zeros(0, np.uint64)]), return_counts=True)
        return {"key": values.view(np.int64), "n": n}

    some = docs.filter(F.pmod(F.xxhash64("__row"), F.lit(COMMON_OF)) == 0).select(utf8(text_col).alias("text"))
    counts = per_batch(run, "key bigint, n bigint", some).groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= COMMON_TEXTS)
    counts = materialize(counts.withColumn("class", F.floor(F.log2("n") * 16)), "common-shingles")
    left, lowest = most, None
    for r in sorted(counts.groupBy("class").agg(F.count(F.lit(1)).alias("k")).collect(), key=lambda r: -r["class"]):
        if r["k"] > left:
            break
        left, lowest = left - r["k"], r["class"]
    if lowest is None:
        return np.zeros(0, np.int64)
    return np.sort(counts.filter(F.col("class") >= lowest).select("key").toPandas()["key"].to_numpy(np.int64))


def prefixed_prints(docs: DataFrame, text_col: str) -> DataFrame:
    """``id, fp, keys``: row number, fingerprint and prefix of every text of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, text_col))  # bounded by COMMON

    def run(batch):
        texts = batch.column(1).to_pylist()
        return {"id": batch.column(0), "fp": [fingerprint_of_set(t) for t in texts], "keys": [prefix(shingle_digests(t, JACCARD_WIDTH), shared.value) for t in texts]}

    return per_batch(run, "id bigint, fp bigint, keys array<bigint>", docs.select(F.col("__row").alias("id"), utf8(text_col).alias("text")))


def shared_keys(prints: DataFrame, distinct: DataFrame) -> DataFrame:
    """``fp, key, n`` of every shingle that the prefixes of ``n`` texts share, two at least; a fingerprint's first text counts."""
    later = materialize(prints.select("id", "fp").join(distinct, "fp").filter(F.col("id") > F.col("first")).select("id"), "later-texts")
    later = later if later.count() > SENT_IDS else F.broadcast(later)
    index = prints.join(later, "id", "left_anti").select("fp", F.explode("keys").alias("key"))
    sizes = index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    return materialize(index.join(unbroadcast(sizes), "key").select("fp", "key", "n"), "shared-shingles")


def similar_links(prints: DataFrame, distinct: DataFrame, docs: DataFrame, text_col: str = "text", large_bucket: int = SIMILAR_BUCKET) -> DataFrame:
    """``a, b``: links between fingerprints of ``distinct`` (``fp, first``: a row number of ``docs``) within
    ``SIMILAR_DISTANCE`` bits whose texts have a Jaccard similarity of ``JACCARD`` at least.

    Texts that share a shingle of their prefixes are compared by fingerprint.  Where too many share one, as in a large
    group of near copies, the fingerprints of those texts are searched as by near_links().
    """
    import numpy as np

    keys = shared_keys(prints, distinct)
    few = keys.filter(F.col("n") <= SHARED * large_bucket).select("fp", "key")
    i, p = few.alias("i"), few.alias("p")
    near = (F.col("i.fp") < F.col("p.fp")) & (differing(F.col("i.fp"), F.col("p.fp")) <= SIMILAR_DISTANCE)
    links = i.join(unbroadcast(p), (F.col("i.key") == F.col("p.key")) & near).select(F.col("p.fp").alias("a"), F.col("i.fp").alias("b"))
    crowd = materialize(keys.filter(F.col("n") > SHARED * large_bucket).select("fp").distinct(), "crowded-fingerprints")
    large = None
    if not crowd.isEmpty():
        plan = plan_partitions(crowd, SIMILAR_DISTANCE, SIMILAR_PARTITIONS)
        index, probes, more, large = buckets(crowd, plan, SIMILAR_DISTANCE, large_bucket)
        links = links.unionByName(more)
    pairs = materialize(links.distinct(), "similar-candidates")
    members = pairs.select(F.explode(F.array("a", "b")).alias("fp"))
    if large is not None:
        members = members.union(index.join(large, ["part", "key"], "left_semi").select("fp")).union(probes.join(large, ["part", "key"], "left_semi").select("fp"))
    wanted = materialize(distinct.join(members.distinct(), "fp", "left_semi"), "similar-members")
    sets = materialize(wanted.join(shingle_sets(docs, wanted.select("first"), text_col, JACCARD_WIDTH), "first").select("fp", "shingles"), "shingle-sets")

    def run(batch):
        left, right = (batch.column(c).to_pylist() for c in ("left", "right"))
        ok = np.zeros(batch.num_rows, bool)
        for k, (x, y) in enumerate(zip(left, right, strict=True)):
            shared = len(set(x).intersection(y))
            ok[k] = shared >= JACCARD * (len(x) + len(y) - shared)
        return {c: batch.column(c).to_numpy(zero_copy_only=False)[ok] for c in ("a", "b")}

    side = lambda k, name: sets.select(F.col("fp").alias(k), F.col("shingles").alias(name))
    alike = per_batch(run, "a bigint, b bigint", pairs.join(side("a", "left"), "a").join(side("b", "right"), "b").select("a", "b", "left", "right"), rows=1024)
    return alike if large is None else alike.unionByName(large_bucket_edges(index, probes, large, SIMILAR_DISTANCE, sets, SIMILAR_BLOCK))


def named_groups(rows: DataFrame, distinct: DataFrame, links: DataFrame) -> DataFrame:
    """``id, fp, component`` of ``rows`` (``id, fp``): the smallest ``first`` that links between fingerprints reach."""
    roots = components(links)
    rooted = distinct.join(roots.select(F.col("a").alias("fp"), F.col("b").alias("root")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = materialize(rooted, "rooted-fingerprints")
    names = rooted.groupBy("root").agg(F.min("first").alias("component"))
    # Written, so that the rows of a much copied fingerprint can be split among tasks in the last join.
    named = materialize(rooted.join(names, "root").select("fp", "component"), "named-fingerprints")
    return rows.join(named, "fp").select("id", "fp", "component")


def _distinct(rows: DataFrame) -> DataFrame:
    return materialize(rows.groupBy("fp").agg(F.min("id").alias("first")), "distinct-fingerprints")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, large_bucket: int = LARGE_BUCKET) -> DataFrame:
    """``id, fp, component`` of every row; ``component`` is the smallest id that links reach, its own included.

    Null texts count as empty; texts without words have fingerprint zero and link like any other.  Null ids join
    groups but never name one that has another id; repeated rows are one document each; an empty table gives an
    empty result.
    """
    rows = keyed(fingerprints(docs, id_col, text_col), "fingerprints").drop("__row")
    distinct = _distinct(rows)
    return named_groups(rows, distinct, near_links(distinct.select("fp"), plan_partitions(distinct.select("fp"), distance), distance, large_bucket))


def keep_one(docs: DataFrame, text_col: str = "text", large_bucket: int = SIMILAR_BUCKET) -> DataFrame:
    """The rows of ``docs`` with one row of each group of near duplicates, the first by row number.

    Near duplicates have a Jaccard similarity of ``JACCARD`` on ``JACCARD_WIDTH``-word shingles, or reach each other
    through such pairs; texts with one fingerprint over their pairs of words count as alike.  Candidates are all pairs
    whose fingerprints differ in ``SIMILAR_DISTANCE`` bits at most.
    """
    rows = numbered(docs)
    prints = materialize(prefixed_prints(rows, text_col), "set-fingerprints")
    distinct = _distinct(prints)
    groups = named_groups(prints.select("id", "fp"), distinct, similar_links(prints, distinct, rows, text_col, large_bucket))
    gone = groups.filter(F.col("id") != F.col("component")).select(F.col("id").alias("__row"))
    return rows.join(materialize(gone, "near-duplicates"), "__row", "left_anti").select(*docs.columns)


@query("op2_simhash_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_groups(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
