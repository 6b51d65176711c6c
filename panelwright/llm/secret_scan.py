"""Secret scans with corpus-wide ownership frequency.

Each text yields candidate spans.  Candidate values travel as hashes: they are counted by distinct owners and distinct
repositories over the whole corpus, so a value copied by many owners is known as an example, while one that a single
owner or two hold, with the entropy of a real credential, is likely live.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed, materialize, per_batch, query, sliced, table, utf8

# The three base kinds with their least lengths.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
KINDS = ("assign", "access", "hex")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")

# Further kinds of this operator: well-known shapes of keys that the base leaves out.
ADDED = {
    # A run of the alphabet is tried at its start only and never given back, so that a text of headers is read once.
    "jwt": r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+",
    "pem": r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\s]{40,}?-----END [A-Z ]{0,20}PRIVATE KEY-----",
    "prefixed": r"(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{30,})",
    "userinfo": r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,64}:[^\s/:@]{6,128}@",
}
ADDED_HINTS = {"jwt": b"eyJ", "pem": b"PRIVATE KEY-----", "prefixed": b"", "userinfo": b"://"}

#: A value held by more owners than this is a copied example.
MAX_OWNERS = 2
#: Bits per character below which a value is a placeholder such as ``xxxxxxxx``.
MIN_ENTROPY = 2.5

SPAN = "struct<kind:string,start:bigint,end:bigint,hash:string,entropy:double>"


def entropy(value: str) -> float:
    """Shannon entropy of the characters, in bits each."""
    from collections import Counter
    from math import log2

    return -sum(n / len(value) * log2(n / len(value)) for n in Counter(value).values()) if value else 0.0


def spans_of(data: bytes, patterns: dict) -> list[tuple[str, int, int, str]]:
    """``kind, start, end, value`` in code points, by start, then kind as listed; leftmost, not overlapping per kind."""
    low = data.lower()
    text = None
    found = []

    def decoded() -> str:
        nonlocal text
        if text is None:
            text = data.decode("utf-8", "replace")
        return text

    if any(k in low for k in KEYWORDS):
        found += [("assign", m.start(), m.end(), m[2]) for m in patterns["assign"].finditer(decoded()) if len(m[2]) >= MIN_ASSIGN]
    if b"AKIA" in data:
        found += [("access", *m.span(), m[0]) for m in patterns["access"].finditer(decoded()) if len(m[0]) >= MIN_ACCESS]
    if patterns["hex_bytes"].search(data):
        found += [("hex", *m.span(), m[0]) for m in patterns["hex"].finditer(decoded())]
    for kind, hint in ADDED_HINTS.items():
        if (hint and hint in data) or (not hint and patterns["prefixed_bytes"].search(data)):
            found += [(kind, *m.span(), m[0]) for m in patterns[kind].finditer(decoded())]
    order = {k: i for i, k in enumerate((*KINDS, *ADDED))}
    return sorted(found, key=lambda x: (x[1], order[x[0]], x[2]))


def compiled() -> dict:
    # A run of hex digits is matched whole, so asking for its least length at once finds the same runs.
    return {
        "assign": re.compile(ASSIGN, re.ASCII | re.IGNORECASE), "access": re.compile(ACCESS), "hex": re.compile(HEX[:-1] + f"{{{MIN_HEX},}}"),
        "hex_bytes": re.compile((HEX[:-1] + f"{{{MIN_HEX}}}").encode()), "prefixed_bytes": re.compile(rb"gh[pousr]_|xox[abprs]-|sk_live_|AIza"),
        **{k: re.compile(v) for k, v in ADDED.items()},
    }


def span_table(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` without its text, with ``spans``; only hashes of values leave the task that read the text."""
    rest = [c for c in docs.columns if c != text_col]

    def run(batch):
        from hashlib import sha256

        patterns = compiled()
        spans = [
            [{"kind": k, "start": a, "end": b, "hash": sha256(v.encode("utf-8", "replace")).hexdigest(), "entropy": entropy(v)} for k, a, b, v in spans_of(t, patterns)]
            for t in batch.column(text_col).to_pylist()
        ]
        return {**{c: batch.column(c) for c in rest}, "spans": spans}

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text_col), f"spans array<{SPAN}>"])
    return per_batch(run, schema, docs)


def ownership(found: DataFrame) -> DataFrame:
    """``hash, n_owners, n_repos, n_places``: one row per candidate value.

    Counting places per (value, owner, repository) first leaves a widely copied value few rows per task.
    """
    each = found.select("owner", "repo", F.explode("spans").alias("s")).groupBy(F.col("s.hash").alias("hash"), "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    by_owner = each.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"), F.sum("n").alias("n"))
    return by_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("repos").alias("n_repos"), F.sum("n").alias("n_places"))


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = None) -> DataFrame:
    """``id, spans`` per row of ``docs``; a span has ``kind, start, end`` (code points, end exclusive), ``hash`` and
    ``entropy`` of its value, ``n_owners``, ``n_repos``, ``n_places`` over the corpus and ``live``.

    A repository is an owner's ``repo_col`` (without it: the document).  Null texts count as empty, null owners or
    repositories as one unnamed owner or repository.  Repeated rows count as places of one repository and are
    returned each; an empty table gives an empty result.
    """
    repo = F.col(id_col if repo_col is None else repo_col).cast("string")
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"),
        F.coalesce(repo, F.lit("")).alias("repo"), utf8(text_col).alias("__text"),
    )
    found = keyed(span_table(rows, "__text"), "secret-spans")
    with_any = found.filter(F.size("spans") > 0)
    owners = materialize(ownership(with_any), "secret-owners")
    live = (F.col("n_owners") <= MAX_OWNERS) & (F.col("s.entropy") >= MIN_ENTROPY)
    each = with_any.select("__row", F.posexplode("spans").alias("__i", "s")).withColumn("hash", F.col("s.hash")).join(owners, "hash")
    span = F.struct("__i", "s.kind", "s.start", "s.end", "s.hash", "s.entropy", "n_owners", "n_repos", "n_places", live.alias("live"))
    # A row's spans are bounded by its text.
    known = each.groupBy("__row").agg(F.array_sort(F.collect_list(span)).alias("__spans"))
    out = found.select("__row", "id").join(known, "__row", "left")
    plain = F.transform("__spans", lambda s: s.dropFields("__i"))
    return out.select("id", F.coalesce(plain, F.expr(f"CAST(array() AS array<{LIVE_SPAN}>)")).alias("spans"))


LIVE_SPAN = SPAN[:-1] + ",n_owners:bigint,n_repos:bigint,n_places:bigint,live:boolean>"
MARK = "[SECRET]"


def cut_spans(text: str, spans: list[tuple[int, int]], mark: str = MARK) -> str:
    """``text`` with ``mark`` in place of the ranges, overlapping ones taken together."""
    out, at = [], 0
    for start, end in sorted(spans):
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], mark]
        at = end
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = None) -> DataFrame:
    """``docs`` with live-looking secrets replaced by ``MARK``; all rows and columns stay.

    Only texts with a candidate leave their task, to meet the corpus-wide counts; the others pass through.
    """
    names = docs.columns

    def some(present: bool):
        def run(batches):
            import pyarrow as pa

            patterns = compiled()
            for batch in sliced(batches):
                texts = batch.column(text_col).cast(pa.binary()).to_pylist()
                yield batch.filter(pa.array([bool(t and spans_of(t, patterns)) == present for t in texts], pa.bool_()))

        return run

    held = keyed(docs.mapInArrow(some(True), docs.schema), "secret-texts")
    found = secret_scan(held, "__row", text_col, owner_col, id_col if repo_col is None else repo_col)
    live = F.transform(F.filter("spans", lambda s: s["live"]), lambda s: F.struct(s["start"], s["end"]))
    joined = held.join(found.select(F.col("id").alias("__row"), live.alias("__live")), "__row").select(*names, "__live")
    where = names.index(text_col)

    def run(batches):
        import pyarrow as pa

        for batch in sliced(batches):
            pairs = zip(batch.column(text_col).to_pylist(), batch.column("__live").to_pylist(), strict=True)
            columns = [batch.column(c) for c in names]
            columns[where] = pa.array([cut_spans(t, [(x["start"], x["end"]) for x in s]) for t, s in pairs], columns[where].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(some(False), docs.schema).unionByName(joined.mapInArrow(run, docs.schema))


def _digest(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


@query("op5_secret_scan")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = secret_scan(docs.withColumn("__repo", F.concat_ws("/", "source", "lang")), repo_col="__repo")
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS))
    return out.select(
        F.col("id").alias("doc_id"), n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
        F.sha2(_digest(base), 256).alias("base_sha256"), _digest(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter("spans", lambda s: ~s["live"])).cast("long").alias("n_example"),
    )
