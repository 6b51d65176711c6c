"""Prefix trie of conversations by ROLLUP over positional turn-id columns.

A conversation is a row of ``BLOCK`` columns, the ids of its first turns; further turns are further rows, each keyed by
the node that the block before it ended in.  One ``ROLLUP`` over the columns, within block and node, aggregates the
prefixes of all lengths in all blocks together, map-side first, so that a prefix that a third of all conversations share is
one row per task.  ``grouping_id`` tells the level of each group.

A turn's id at a depth is a pair of 64-bit hashes of the depth and of 128 bits of the turn's SHA-256; a node's key is the
exclusive or of its turns' ids, so that of a block is its total with those before it, and no block waits for another.

Sums over subtrees take a second rollup.  Every node is represented by its smallest member.  What a conversation represents
is the end of its path; so the sum over a subtree is the sum of its members' totals, less what the smallest member
represents above the top.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from hashlib import sha256

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranks import positions, totals_before
from .common import keyed, materialize, query, table

BLOCK = 8

# Fixed values of the query: conversations of so many ids share the head of the first, of fewer turns than this.
FAMILY, HEAD = 100, 6


@dataclass(frozen=True)
class Trie:
    """``nodes``: ``a, b`` (key), ``parent_a, parent_b``, ``depth, conv_id`` (smallest member), ``parent_conv_id, n_convs,
    n_children, n_leaves, chars`` (of the last turn), ``saved``; ``ends``: ``a, b, conv_id`` where each conversation ends.
    """

    nodes: DataFrame
    ends: DataFrame


def turn_ids(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """``conv_id, at, turn_id, chars``: the turns in order, ``at`` from 1, without their texts.

    Turns stand by number, null first; turns of one number by the SHA-256 of role and text.  Null roles and texts are
    empty.  Rows without a conversation id belong to no conversation and are left out.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    said = F.concat(F.length(text(role_col)).cast("string"), F.lit(":"), text(role_col), text(text_col))
    slim = conversations.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"),
        F.unhex(F.substring(F.sha2(said.cast("binary"), 256), 1, 32)).alias("turn_id"), F.length(text(text_col)).cast("long").alias("chars"),
    )
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "turn_id", "__row")]
    placed = positions(keyed(slim, "turns"), order, "__place")
    first = placed.groupBy("conv_id").agg(F.min("__place").alias("__first"))
    return materialize(
        placed.join(first, "conv_id").select("conv_id", (F.col("__place") - F.col("__first") + 1).alias("at"), "turn_id", "chars"), "turns-in-order"
    )


def shared_heads(turns: DataFrame, family: int = FAMILY, head: int = HEAD) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt on the head of their family's first one, as ``turns``, and all their ids.

    Of conversation ``c`` the first ``h`` turns are those of ``c - c % family`` (all it has if fewer, none if it is absent),
    ``h`` being the CRC-32 of ``c`` in decimals modulo ``head``; its own turns after its first ``h`` follow.
    """
    ids = turns.select("conv_id").distinct().withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % head)
    heads = turns.filter((F.col("conv_id") % family == 0) & (F.col("at") < head)).groupBy(F.col("conv_id").alias("base")).agg(
        F.sort_array(F.collect_list(F.struct("at", "turn_id", "chars"))).alias("head")
    )
    known = ids.withColumn("base", F.col("conv_id") - F.col("conv_id") % family).join(heads, "base", "left")
    known = known.select("conv_id", "h", F.coalesce(F.expr("slice(head, 1, int(h))"), F.expr("slice(head, 1, 0)")).alias("head"))
    known = materialize(known.withColumn("n_head", F.coalesce(F.size("head"), F.lit(0))), "heads")
    own = turns.join(known.select("conv_id", "h", "n_head"), "conv_id").filter("at > h").select(
        "conv_id", (F.col("at") - F.col("h") + F.col("n_head")).alias("at"), "turn_id", "chars"
    )
    taken = known.select("conv_id", F.explode("head").alias("t")).select("conv_id", "t.at", "t.turn_id", "t.chars")
    return own.unionByName(taken), known.select("conv_id")


def _columns(block: int) -> list[str]:
    return [f"t{i + 1}" for i in range(block)]


def blocks(turns: DataFrame, ids: DataFrame, block: int = BLOCK) -> DataFrame:
    """``conv_id, blk, pa, pb, t1 ... , chars, xa, xb``: a row per conversation and block of turns.

    ``pa, pb`` is the node in which the block before ended.  Every conversation has a first block, if an empty one.
    """
    at = F.col("at")
    steps = turns.select(
        "conv_id", F.expr(f"(at - 1) div {block}").alias("blk"), ((at - 1) % block).alias("j"), "chars",
        F.xxhash64(at, "turn_id").alias("a"), F.xxhash64("turn_id", at).alias("b"),
    )
    empty = ids.select("conv_id", F.lit(0).cast("long").alias("blk"), *[F.lit(None).cast("long").alias(c) for c in ("j", "chars", "a", "b")])
    here = lambda i, value: F.max(F.when(F.col("j") == i, value))
    rows = steps.unionByName(empty).groupBy("conv_id", "blk").agg(
        *[here(i, F.struct("a", "b")).alias(t) for i, t in enumerate(_columns(block))],
        F.array(*[here(i, F.col("chars")) for i in range(block)]).alias("chars"),
        *[F.coalesce(F.bit_xor(c), F.lit(0)).alias(f"x{c}") for c in ("a", "b")],
    )
    running = totals_before(rows, [F.col("conv_id").asc(), F.col("blk").asc()], {"pa": "xa", "pb": "xb"}, F.bit_xor)
    # The running total goes over all conversations: what stood before the conversation's first block comes off.
    first = running.filter("blk = 0").select("conv_id", F.col("pa").alias("oa"), F.col("pb").alias("ob"))
    out = running.join(first, "conv_id").withColumns({p: F.col(p).bitwiseXOR(F.col(o)) for p, o in (("pa", "oa"), ("pb", "ob"))})
    return materialize(out.drop("oa", "ob"), "blocks")


def rollup(rows: DataFrame, totals: str, block: int = BLOCK) -> DataFrame:
    """One row per node with ``level`` in its block, the aggregates ``totals`` and its block's node and ids."""
    ts = ", ".join(_columns(block))
    groups = rows.sparkSession.sql(
        f"SELECT blk, pa, pb, {ts}, {block} - bit_count(grouping_id()) AS level, {totals} FROM {{rows}} GROUP BY blk, pa, pb, ROLLUP({ts})", rows=rows
    )
    # A level below the end of a conversation is no node, and level 0 is the last node of the block before.
    last = F.get(F.array(*_columns(block)), F.col("level") - 1)
    return groups.withColumn("last", last).filter("last IS NOT NULL OR (level = 0 AND blk = 0)").withColumn("depth", F.col("blk") * block + F.col("level"))


def _lane(start: str, lane: str, block: int) -> Column:
    return reduce(Column.bitwiseXOR, (F.coalesce(F.col(f"{t}.{lane}"), F.lit(0)) for t in _columns(block)), F.col(start))


def build(turns: DataFrame, ids: DataFrame, block: int = BLOCK) -> Trie:
    """The trie of ``turns`` (``conv_id, at, turn_id, chars``) of the conversations ``ids``, some of which may have no turn."""
    rows = blocks(turns, ids, block)
    found = rollup(rows, "count(*) AS n_convs, min(conv_id) AS conv_id, first(chars) AS lengths", block)
    # Up to its level, any member's lengths are those of all members.
    chars = F.coalesce(F.get("lengths", F.col("level") - 1), F.lit(0))
    nodes = found.select(_lane("pa", "a", block).alias("a"), _lane("pb", "b", block).alias("b"), "last", "depth", "conv_id", "n_convs", chars.alias("chars"))
    nodes = materialize(nodes.select(
        "a", "b", F.col("a").bitwiseXOR(F.col("last.a")).alias("parent_a"), F.col("b").bitwiseXOR(F.col("last.b")).alias("parent_b"),
        "depth", "conv_id", "n_convs", "chars", ((F.col("n_convs") - 1) * F.col("chars")).alias("__own"),
    ), "nodes")
    children = nodes.filter("depth > 0").groupBy(F.col("parent_a").alias("a"), F.col("parent_b").alias("b")).agg(F.count(F.lit(1)).alias("n_children"))
    counted = nodes.join(children, ["a", "b"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    counted = counted.withColumn("__leaf", (F.col("n_children") == 0).cast("long"))

    # What each conversation represents, and on each node how much of it lies above.
    ahead = totals_before(counted, [F.col("conv_id").asc(), F.col("depth").asc()], {"__own_ahead": "__own", "__leaf_ahead": "__leaf"})
    ahead = materialize(ahead, "nodes-in-order")
    stands = ahead.groupBy("conv_id").agg(
        *[F.sum(f"__{c}").alias(f"{c}_all") for c in ("own", "leaf")], *[F.min(f"__{c}_ahead").alias(f"{c}_first") for c in ("own", "leaf")]
    )
    stands = materialize(stands, "represented")
    weighted = rows.drop("chars", "xa", "xb").join(stands.select("conv_id", "own_all", "leaf_all"), "conv_id", "left")
    sums = rollup(weighted, "min(conv_id) AS conv_id, coalesce(sum(own_all), 0) AS own_sum, coalesce(sum(leaf_all), 0) AS leaf_sum", block)
    parents = nodes.select(F.col("a").alias("parent_a"), F.col("b").alias("parent_b"), F.col("conv_id").alias("parent_conv_id"))
    out = (
        ahead.join(sums.select("conv_id", "depth", "own_sum", "leaf_sum"), ["conv_id", "depth"])
        .join(stands.select("conv_id", "own_first", "leaf_first"), "conv_id")
        .join(parents, ["parent_a", "parent_b"], "left")
    )
    subtree = lambda c: F.col(f"{c}_sum") - (F.col(f"__{c}_ahead") - F.col(f"{c}_first"))
    nodes = out.select(
        "a", "b", "parent_a", "parent_b", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children",
        subtree("leaf").alias("n_leaves"), "chars", subtree("own").alias("saved"),
    )
    return Trie(nodes, rows.groupBy("conv_id").agg(F.bit_xor("xa").alias("a"), F.bit_xor("xb").alias("b")).select("a", "b", "conv_id"))


def prefix_trie(conversations: DataFrame, block: int = BLOCK, **columns: str) -> Trie:
    """The trie of whole conversations.  Equal turns are turns of equal role and text.

    The root has no turn.  An empty table has no node; repeated rows are turns of their own.  A conversation of any length
    is spread over tasks by its blocks, a prefix of any number of members is combined before it is moved.
    """
    turns = turn_ids(conversations, **columns)
    return build(turns, turns.select("conv_id").distinct(), block)


def last_turns(
    nodes: DataFrame, conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """Adds ``turn_id, role`` and ``text`` of each node's last turn, null at the root: a trie's texts, each once per node."""
    names = {"conv_col": conv_col, "turn_col": turn_col, "role_col": role_col, "text_col": text_col}
    ids = turn_ids(conversations, **names)
    here = nodes.join(ids.select("conv_id", F.col("at").alias("depth"), "turn_id"), ["conv_id", "depth"], "left")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    said = F.concat(F.length(text(role_col)).cast("string"), F.lit(":"), text(role_col), text(text_col))
    known = conversations.groupBy(F.unhex(F.substring(F.sha2(said.cast("binary"), 256), 1, 32)).alias("turn_id")).agg(
        F.first(text(role_col)).alias("role"), F.first(text(text_col)).alias("text")
    )
    return here.join(known, "turn_id", "left")


def end_digests(ends: DataFrame) -> DataFrame:
    """``a, b, ends_sha256``: SHA-256 of the ids that end in a node, ascending, comma-joined.

    The digest reads a node's ids in order, so they pass through one task; they are streamed, and none is kept.
    """

    def run(batches):
        import pyarrow as pa

        key, digest = None, None
        for batch in batches:
            a, b, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            done = ([], [], [])
            cuts = [0, *(((a[1:] != a[:-1]) | (b[1:] != b[:-1])).nonzero()[0] + 1).tolist(), len(a)] if len(a) else []
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                text = ",".join(map(str, ids[lo:hi].tolist())).encode()
                if (a[lo], b[lo]) == key:
                    digest.update(b"," + text)
                    continue
                if digest is not None:
                    for column, value in zip(done, (*key, digest.hexdigest()), strict=True):
                        column.append(value)
                key, digest = (a[lo], b[lo]), sha256(text)
            yield pa.RecordBatch.from_arrays([pa.array(done[0], pa.int64()), pa.array(done[1], pa.int64()), pa.array(done[2], pa.string())], ["a", "b", "ends_sha256"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([digest.hexdigest()])], ["a", "b", "ends_sha256"])

    ordered = ends.repartition("a", "b").sortWithinPartitions("a", "b", "conv_id")
    return ordered.select("a", "b", "conv_id").mapInArrow(run, "a bigint, b bigint, ends_sha256 string")


def _sql() -> str:
    table_of = "list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
    crc = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(CAST(conv_id AS VARCHAR))), '..'), lambda h: ('0x' || h)::BIGINT)), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295::BIGINT)"
    return f"""WITH k AS (SELECT {table_of} AS tab),
said AS (SELECT conv_id, turn, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS s FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list(s ORDER BY turn NULLS FIRST, sha256(concat(length(s.role), ':', s.role, s.text))) AS own FROM said GROUP BY conv_id),
h AS (SELECT conv_id, own, {crc} % {HEAD} AS h FROM c, k),
r AS (SELECT h.conv_id, list_concat(list_slice(coalesce(b.own, []), 1, h), list_slice(h.own, h + 1, len(h.own))) AS path FROM h LEFT JOIN c b ON b.conv_id = h.conv_id - h.conv_id % {FAMILY}),
n AS (SELECT list_slice(path, 1, d) AS p, d, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE len(path) = d), '')) AS ends_sha256
    FROM (SELECT conv_id, path, unnest(range(len(path) + 1)) AS d FROM r) GROUP BY 1, 2),
f AS (SELECT n.*, u.conv_id AS parent_conv_id, (SELECT count(*) FROM n v WHERE v.d = n.d + 1 AND list_slice(v.p, 1, n.d) = n.p) AS n_children
    FROM n LEFT JOIN n u ON u.d = n.d - 1 AND u.p = list_slice(n.p, 1, n.d - 1)),
s AS (SELECT list_slice(p, 1, e) AS p, e AS d, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(CASE WHEN d > 0 THEN (n_convs - 1) * length(p[d].text) ELSE 0 END) AS saved
    FROM (SELECT *, unnest(range(d + 1)) AS e FROM f) GROUP BY 1, 2)
SELECT conv_id, d AS depth, parent_conv_id, n_convs, n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, ends_sha256 FROM f JOIN s USING (p, d)"""


@query("op13_prefix_trie", _sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    trie = build(*shared_heads(turn_ids(table(spark, sf_dir, "conversations"))))
    nodes = trie.nodes.join(end_digests(trie.ends), ["a", "b"], "left")
    return nodes.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(sha256(b"").hexdigest())).alias("ends_sha256"),
    )
