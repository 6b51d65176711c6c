"""Chat formatting in budgeted windows.

A conversation becomes one or more formatted texts of at most a token budget.  Prefix sums of the turns' token counts
choose turn-aligned spans; every window starts with the system turn, repeats the last turns before its span as far as
the history budget goes, and masks them, so each target is trained on once.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import deque
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, per_batch, query, sliced, table

# Fixed values of the template.  ESCAPE followed by a letter stands for ESCAPE itself and for each control string.
BOS, EOS, INST, END_INST, SYS, END_SYS = "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"
TURN, END_TURN = "<|turn|>", "<|end|>"
ESCAPE = "\\"
CONTROLS = (EOS, BOS, END_INST, INST, END_SYS, SYS, TURN, END_TURN)

BUDGET, HISTORY, PER_TURN = 512, 128, 8
TARGET_ROLE, SYSTEM_ROLE = "assistant", "system"

_CODES = {c: ESCAPE + "abcdefgh"[i] for i, c in enumerate(CONTROLS)} | {ESCAPE: ESCAPE + "z"}
# A line break ends the role, so within a role it has a code as well.
BREAK = ESCAPE + "y"
_TEXTS = {v: k for k, v in _CODES.items()} | {BREAK: "\n"}
_TO = re.compile("|".join(map(re.escape, _CODES)))
_FROM = re.compile(re.escape(ESCAPE) + "[a-z]")


def escape(text: str) -> str:
    """Replaces the escape character and all control strings, so that none is left in the text."""
    return _TO.sub(lambda m: _CODES[m[0]], text)


def unescape(text: str) -> str:
    return _FROM.sub(lambda m: _TEXTS[m[0]], text)


def tokens(text: str) -> int:
    """The budget's measure: words and single marks, plus a constant for the turn's own marks."""
    return len(re.findall(r"\w+|[^\w\s]", text)) + PER_TURN


def spans(costs: list[int], budget: int, history: int) -> list[tuple[int, int, int]]:
    """``shown, start, end``: turns ``start..end`` are new in a window, ``shown..start`` are repeated before them.

    Found on prefix sums by bisection.  A turn that is over the budget alone gets a window of its own.
    """
    total = [0]
    for c in costs:
        total.append(total[-1] + c)
    out, start = [], 0
    while start < len(costs):
        # History goes back to the first turn whose sum still fits, and gives way to the next turn.
        room = min(history, budget - costs[start])
        shown = start if room <= 0 else min(start, bisect_right(total, total[start] - room - 1))
        end = max(start + 1, bisect_right(total, total[shown] + budget) - 1)
        out.append((shown, start, end))
        start = end
    return out


def formatted(turns: Iterable[tuple[str, str, bool]]) -> tuple[str, list[tuple[int, int]]]:
    """A window's text and the ranges that are trained on, from ``role, text, new`` of its turns."""
    parts, mask, at = [BOS], [], len(BOS)
    for role, text, new in turns:
        head, body = f"{TURN}{escape(role).replace(chr(10), BREAK)}\n", escape(text)
        if new and role == TARGET_ROLE:
            mask.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END_TURN]
        at += len(head) + len(body) + len(END_TURN)
    return "".join([*parts, EOS]), mask


def stream_windows(turns: Iterable[tuple[str, str, int]], budget: int = BUDGET, history: int = HISTORY) -> Iterator[tuple[str, list[tuple[int, int]], int, int, bool]]:
    """``text, mask, start, repeated, has_lead`` per window from ``role, text, cost`` of a conversation's turns in order.

    The spans are those of ``spans``; held are the lead and the turns of one window, whose last ones are the history of
    the next.
    """
    turns = iter(turns)
    lead, shown, filled, start, first = [], deque(), 0, 0, True
    repeated = 0  # of ``shown``, the turns that an earlier window has trained on

    def window():
        new = len(shown) - repeated
        text, mask = formatted([(r, t, False) for r, t, _ in lead] + [(r, t, i >= repeated) for i, (r, t, _) in enumerate(shown)])
        return (text, mask, -1 if lead and not start else start, repeated, bool(lead)), new

    room = max(budget, 1)
    for turn in turns:
        if first and turn[0] == SYSTEM_ROLE:
            lead, room, first = [turn], max(budget - turn[2], 1), False
            continue
        first = False
        if len(shown) > repeated and filled + turn[2] > room:
            out, new = window()
            yield out
            start += new
            # History goes back to the first turn whose sum still fits, and gives way to the next turn.
            left = min(history, room - turn[2])
            while shown and filled > max(left, 0):
                filled -= shown.popleft()[2]
            repeated = len(shown)
        shown.append(turn)
        filled += turn[2]
    if shown or lead:
        yield window()[0]


def windows(turns: list[tuple[str, str]], budget: int = BUDGET, history: int = HISTORY) -> Iterator[tuple[str, list[tuple[int, int]], int]]:
    """``text, mask, start`` per window: the formatted text, the code point ranges that are trained on, and the number
    of the first turn that is new in it (-1 for the system turn, which leads every window)."""
    return (w[:3] for w in stream_windows(((r, t, tokens(t)) for r, t in turns), budget, history))


_TURN = re.compile(re.escape(TURN) + r"(.*?)\n(.*?)" + re.escape(END_TURN), re.DOTALL)


def read_back(formatted: Iterable[tuple[str, list[tuple[int, int]], int, int]]) -> Iterator[tuple[str, str, str | None]]:
    """``role, text, loss`` of each turn from ``text, mask, shown, has_lead`` of a conversation's windows in order.

    ``shown`` is how many turns after the lead repeat earlier ones; ``loss`` is the unescaped text under the mask.
    """
    for k, (text, mask, shown, has_lead) in enumerate(formatted):
        for i, m in enumerate(_TURN.finditer(text)):
            lead = has_lead and i == 0
            if (lead and k) or (not lead and i - has_lead < shown):
                continue
            under = [text[a:b] for a, b in mask if a >= m.start(2) and b <= m.end(2)]
            yield unescape(m[1]), unescape(m[2]), unescape("".join(under)) if under else None


WINDOW_SCHEMA = "conv_id bigint, window int, repeated int, has_lead boolean, text string, loss array<struct<start:int,end:int>>"


def chat_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Windows of all conversations of ``turns`` (``conv_id, turn, role, text``): ``conv_id, window, repeated,
    has_lead, text, loss``.

    Turns go by number, ties by role, then text; null roles and texts count as empty, a null conversation id is a
    conversation of its own, repeated rows are turns.  A system turn leads only if it comes first; later ones are
    ordinary.  Tokens are counted before the sort.  Conversations are read one after the other from partitions sorted
    by id and turn, and of a conversation only its lead, the history and the window that is being filled are held, so
    memory is bounded by the batch, the budget and the longest single turn.
    """
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )

    def run(batches):
        import pyarrow as pa
        from itertools import groupby

        schema = to_arrow()

        def each():
            for batch in sliced(batches):
                yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "cost")), strict=True)

        out: list[dict] = []
        size = 0
        for conv, group in groupby(each(), key=lambda x: x[0]):
            for k, (text, mask, _, again, lead) in enumerate(stream_windows((x[1:] for x in group), budget, history)):
                out.append({"conv_id": conv, "window": k, "repeated": again, "has_lead": lead, "text": text, "loss": [{"start": a, "end": b} for a, b in mask]})
                size += len(text)
                if size > 1 << 22:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out, size = [], 0
        yield pa.RecordBatch.from_pylist(out, schema=schema)

    def to_arrow():
        import pyarrow as pa

        return pa.schema([
            ("conv_id", pa.int64()), ("window", pa.int32()), ("repeated", pa.int32()), ("has_lead", pa.bool_()), ("text", pa.string()),
            ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
        ])

    def count(batch):
        return {**{c: batch.column(c) for c in ("conv_id", "turn", "role", "text")}, "cost": [tokens(t) for t in batch.column("text").to_pylist()]}

    counted = per_batch(count, "conv_id bigint, turn bigint, role string, text string, cost bigint", rows)
    return counted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, WINDOW_SCHEMA)


DIGEST_SCHEMA = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_windows bigint"


def window_digests(formatted: DataFrame) -> DataFrame:
    """Reads conversations back from their windows and sums them up, one row each."""

    def run(batches):
        import pyarrow as pa
        from hashlib import sha256
        from itertools import groupby

        names = ("conv_id", "text", "loss", "repeated", "has_lead")

        def each():
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in names), strict=True)

        rows = []
        for conv, group in groupby(each(), key=lambda x: x[0]):
            chars = count = 0
            n = loss_chars = 0
            every, loss = sha256(), sha256()

            def windowed(group=group):
                nonlocal chars, count
                for _, text, mask, again, lead in group:
                    chars += len(text)
                    count += 1
                    yield text, [(x["start"], x["end"]) for x in mask], again, lead

            for role, text, target in read_back(windowed()):
                n += 1
                every.update(f"{role}\n{text}\n".encode())
                if target is not None:
                    loss_chars += len(target)
                    loss.update(target.encode())
            rows.append((conv, n, every.hexdigest(), loss_chars, loss.hexdigest(), chars, count))
        columns = list(zip(*rows, strict=True)) or [[]] * 7
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        fields = [x.split()[0] for x in DIGEST_SCHEMA.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], fields)

    return formatted.repartition("conv_id").sortWithinPartitions("conv_id", "window").mapInArrow(run, DIGEST_SCHEMA)


@query("op6_chat_windows")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(1).select(
        F.lit(-1).cast("long").alias("conv_id"), F.explode(F.array(F.struct(F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role")), F.struct(F.lit(1).cast("long").alias("turn"), F.lit("assistant").alias("role")))).alias("t")
    ).select("conv_id", "t.turn", "t.role", F.lit(said).alias("text"))
    return window_digests(materialize(chat_windows(turns.unionByName(extra)), "chat-windows"))
