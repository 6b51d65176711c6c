"""Quality rules: an isolation forest on rule statistics, calibrated from labelled rows.

``rule_table`` counts per document (one pass, no shuffle).  ``fit`` grows random trees, each on its own draw from the
rule ratios of all good labelled rows, and takes the anomaly threshold from all labelled rows; every document then walks
through all trees.  Documents that fail the plain rules are rejected whatever the forest says.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import unbroadcast
from .common import materialize, per_batch, query, sliced, table, utf8
from .rule_stats import COUNTS, counts

#: Labelled rows that the driver reads and fits on; with more of them it reads what the trees draw, and the executors score.
HELD = 20_000
#: Labelled ids that are sent to every task, so that other texts are not counted for the fit.
SENT_IDS = 2_000_000
#: Classes of scores whose rows are counted to find the threshold among many.
CLASSES = 1 << 16
TREES, SUBSAMPLE, DEPTH, SEED = 100, 256, 12, 7
#: Share of labelled good documents that the threshold may reject at most.
MAX_GOOD_REJECTED = 0.001
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
RATIOS = ("word_length", "symbols", "dup_lines", "repeats", "upper", "marks", "echoes", "top_word")

STATS_SCHEMA = "id bigint, " + ", ".join(f"{c} bigint" for c in COUNTS)


def count_columns(texts: list[bytes]) -> dict:
    rows = [counts(t) for t in texts]
    return dict(zip(COUNTS, zip(*rows), strict=True)) if rows else {c: [] for c in COUNTS}


def rule_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and the ``COUNTS`` of every row; null texts count as empty."""

    def run(batch):
        return {"id": batch.column(0), **count_columns(batch.column(1).to_pylist())}

    return per_batch(run, STATS_SCHEMA, docs.select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("text")))


def base_failed(c: dict):
    """Whether the plain rules reject, from a dict of count arrays."""
    import numpy as np

    c = {k: np.asarray(v, dtype=np.int64) for k, v in c.items()}
    return (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])


def ratios(c: dict):
    """The forest's features from a dict of count arrays: a row per document, a column per name in ``RATIOS``."""
    import numpy as np

    c = {k: np.asarray(v, dtype=float) for k, v in c.items()}
    words, chars, lines = (np.maximum(c[k], 1.0) for k in ("n_words", "word_chars", "n_lines"))
    return np.column_stack([
        c["word_chars"] / words, c["n_symbols"] / words, c["n_dup_lines"] / lines, c["n_repeat_words"] / words,
        c["n_upper"] / chars, c["n_marks"] / words, c["n_echoes"] / words, c["n_top"] / words,
    ])


def mean_path(n: float) -> float:
    """Mean path length of an unsuccessful search among ``n`` rows, which stands for an ungrown subtree."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


@dataclass
class Forest:
    """Trees as arrays of nodes: ``feature`` (-1: leaf), ``cut``, ``low`` and ``high`` child, ``path`` of a leaf."""

    feature: object
    cut: object
    low: object
    high: object
    path: object
    roots: list[int]
    norm: float
    threshold: float = float("inf")

    def score(self, x):
        """Anomaly score in (0, 1) per row: 2 to the minus mean path over the expected path."""
        import numpy as np

        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(DEPTH):
                f = self.feature[at]
                go = np.where(x[rows, np.maximum(f, 0)] < self.cut[at], self.low[at], self.high[at])
                at = np.where(f < 0, at, go)
            total += self.path[at]
        return np.power(2.0, -total / len(self.roots) / self.norm)


def grow(x, lo, hi, seed: int = SEED, draws: list | None = None) -> Forest:
    """Isolation trees over random subsamples of ``x``, or over ``draws``, a matrix per tree: a random feature and a random
    cut of the node's box.

    The box starts as ``[lo, hi]`` per feature and is halved by each cut, so a feature that is constant in the
    sample is still cut, and values away from it end in an empty leaf after few cuts.
    """
    import numpy as np

    rng = np.random.default_rng(seed)
    nodes: list[list[float]] = []
    size = min(SUBSAMPLE, len(x)) if draws is None else max(map(len, draws))
    vary = np.flatnonzero(hi > lo)

    def node(rows, lo, hi, depth: int) -> int:
        me = len(nodes)
        nodes.append([-1, 0.0, me, me, depth + mean_path(len(rows))])
        if depth < DEPTH and len(rows) > 1 and len(vary):
            f = int(rng.choice(vary))
            cut = float(rng.uniform(lo[f], hi[f]))
            below, above = hi.copy(), lo.copy()
            below[f] = above[f] = cut
            left = rows[:, f] < cut
            nodes[me][:2] = [f, cut]
            nodes[me][2] = node(rows[left], lo, below, depth + 1)
            nodes[me][3] = node(rows[~left], above, hi, depth + 1)
        return me

    roots = [node(x[rng.choice(len(x), size, replace=False)] if draws is None else draws[k], lo, hi, 0) for k in range(TREES)]
    a = np.array(nodes)
    return Forest(a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4], roots, mean_path(size) or 1.0)


def calibrate(scores, good, most: float = MAX_GOOD_REJECTED) -> float:
    """The threshold (reject above it) that catches the most bad rows while at most a share ``most`` of the good ones
    lies above; ties of scores stay together.  Without bad rows nothing is rejected."""
    import numpy as np

    if good.all() or not len(good):
        return float("inf")
    own = np.sort(scores[good])
    limit = own[min(len(own) - 1, int(np.ceil((1 - most) * len(own))))] if len(own) else scores.min() - 1.0
    above = scores[scores > limit]
    # Halfway into the gap above the last score that has to stay.
    return float((limit + above.min()) / 2) if len(above) else float(limit)


def labelled(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """``id, good`` of every labelled id: good if all its labels are 1; null labels and null ids are left out."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    return known.groupBy(F.col(id_col).cast("long").alias("id")).agg((F.min(label_col) == 1).alias("good"))


def labelled_ratios(counted: DataFrame, y: DataFrame) -> DataFrame:
    """``id, good`` and the ``RATIOS`` of all labelled rows that pass the plain rules."""
    # One row per id, the one with the least counts: repeated rows do not weigh more.
    least = counted.groupBy("id").agg(F.min(F.struct(*COUNTS)).alias("c"))
    own = least.join(unbroadcast(y), "id").select("id", "good", "c.*")

    def run(batch):
        import pyarrow as pa

        c = {k: batch.column(k).to_numpy() for k in COUNTS}
        passed = pa.array(~base_failed(c))
        x = ratios(c)[passed.to_numpy(zero_copy_only=False)]
        return {k: batch.column(k).filter(passed) for k in ("id", "good")} | {k: x[:, i].copy() for i, k in enumerate(RATIOS)}

    return per_batch(run, "id bigint, good boolean, " + ", ".join(f"{k} double" for k in RATIOS), own)


def drawn(rows: DataFrame, n: int, seed: int = SEED) -> list:
    """A matrix of ratios per tree: the ``SUBSAMPLE`` of all ``n`` rows with the smallest hashes of id and tree.

    Only rows with a hash among the smallest, twice as many as a tree takes, come to the driver.
    """
    import numpy as np

    least = F.lit(-(1 << 63) + min(2 * SUBSAMPLE * (1 << 64) // n, (1 << 64) - 1))
    each = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1)))).withColumn("h", F.xxhash64("id", "tree", F.lit(seed)))
    some = each.filter(F.col("h") <= least).select("tree", "h", "id", *RATIOS).toPandas().sort_values(["tree", "h", "id"])
    return [some.loc[some["tree"] == k, list(RATIOS)].to_numpy(np.float64)[:SUBSAMPLE] for k in range(TREES)]


def threshold_among(rows: DataFrame, forest: Forest, n_good: int, most: float = MAX_GOOD_REJECTED) -> float:
    """``calibrate`` over a table: counts by class of score tell the class of the last good score that has to stay, and the
    class's own scores tell it."""
    import numpy as np

    def run(batch):
        return {"good": batch.column("good"), "score": forest.score(np.column_stack([batch.column(k).to_numpy() for k in RATIOS]))}

    scores = materialize(per_batch(run, "good boolean, score double", rows), "labelled-scores")
    if not n_good:
        limit = scores.agg(F.min("score")).first()[0] - 1.0
    else:
        left = min(n_good - 1, math.ceil((1 - most) * n_good))

        def holds(own: DataFrame, key: str):
            """The least ``key`` with over ``left`` rows up to it, and how many of ``left`` those below it leave."""
            before = left
            for r in sorted(own.groupBy(key).agg(F.count(F.lit(1)).alias("k")).collect(), key=lambda r: r[key]):
                if before < r["k"]:
                    return r[key], before
                before -= r["k"]

        good = scores.filter("good").withColumn("class", F.floor(F.col("score") * CLASSES))
        name, left = holds(good, "class")
        limit = holds(good.filter(F.col("class") == name), "score")[0]
    above = scores.filter(F.col("score") > limit).agg(F.min("score")).first()[0]
    return limit if above is None else (limit + above) / 2


def fit(counted: DataFrame, y: DataFrame, held: int = HELD) -> Forest | None:
    """A forest from the labelled rows (``y``: ``id, good``) of ``counted`` that pass the plain rules; None where there are none."""
    import numpy as np

    rows = materialize(labelled_ratios(counted, y), "labelled-ratios")
    box = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"), *(f(k).alias(f"{f.__name__}_{k}") for k in RATIOS for f in (F.min, F.max))).first()
    if not box["n"]:
        return None
    lo, hi = (np.array([box[f"{f}_{k}"] for k in RATIOS]) for f in ("min", "max"))
    if box["n"] <= held:
        own = rows.orderBy("id").toPandas()
        x, good = own[list(RATIOS)].to_numpy(np.float64), own["good"].to_numpy(bool)
        forest = grow(x[good] if good.any() else x, lo, hi)
        forest.threshold = calibrate(forest.score(x), good)
        return forest
    forest = grow(None, lo, hi, draws=drawn(rows.filter("good"), box["good"]) if box["good"] else drawn(rows, box["n"]))
    if box["good"] < box["n"]:
        forest.threshold = threshold_among(rows, forest, box["good"])
    return forest


def fit_forest(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", held: int = HELD) -> Forest | None:
    """``fit`` on the texts of ``docs`` themselves; those without a label are passed over while the labelled ids are few."""
    y = materialize(labelled(labels, id_col, label_col), "labelled")
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    if y.count() <= SENT_IDS:
        own = own.join(F.broadcast(y.select("id")), "id", "left_semi")
    return fit(rule_table(own, "id", "text"), y, held)


def verdicts(c: dict, forest: Forest | None):
    """``base_failed, anomaly, kept`` as arrays; without a forest the anomaly is zero."""
    import numpy as np

    failed = base_failed(c)
    anomaly = forest.score(ratios(c)) if forest and len(failed) else np.zeros(len(failed))
    return failed, anomaly, ~failed & (anomaly <= (forest.threshold if forest else 0.0))


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, the ``COUNTS``, ``base_failed``, ``anomaly`` (0 to 1) and ``kept`` for every row of ``docs``.

    Null or empty texts have zero counts and fail the rules; repeated rows are judged row by row alike; an empty
    table gives an empty result.  Texts are read once: the fit and the verdicts share the counts.
    """
    counted = materialize(rule_table(docs, id_col, text_col), "rule-counts")
    forest = fit(counted, materialize(labelled(labels, id_col), "labelled"))

    def run(batch):
        c = {k: batch.column(k) for k in COUNTS}
        failed, anomaly, kept = verdicts(c, forest)
        return {"id": batch.column("id"), **c, "base_failed": failed, "anomaly": anomaly, "kept": kept}

    return per_batch(run, STATS_SCHEMA + ", base_failed boolean, anomaly double, kept boolean", counted)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, with all their columns."""
    forest = fit_forest(docs, labels, id_col, text_col)

    def run(batches):
        import pyarrow as pa

        for batch in sliced(batches):
            texts = batch.column(text_col).cast(pa.binary()).to_pylist()
            kept = verdicts(count_columns([t or b"" for t in texts]), forest)[2]
            yield batch.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)


@query("op8_quality_rules")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("anomaly", 6).alias("anomaly")
    )
