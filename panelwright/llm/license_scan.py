"""License scans: an exact set-similarity join of text blocks with license templates, in native operations only.

A block (a line) matches a template if it holds at least a share ``CONTAINMENT`` of the template's distinct words.
Words are ordered by how many documents of the corpus hold them, rarest first.  Of a template with ``n`` words of
which ``a`` must be present, some of the first ``n - a + 1`` must be, so only those are joined (prefix filter); blocks
with fewer than ``a`` known words (length filter) and matches after which too few words are left (positional filter)
go before the overlap is counted.
"""

from __future__ import annotations

from fractions import Fraction
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, keyed, query, table

# The phrases of the base and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Notices of common licenses.
TEMPLATES = (
    ("agpl", "this program is licensed under the gnu affero general public license version 3"),
    ("apache", "licensed under the apache license version 2.0"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4.0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4.0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("lgpl", "this library is licensed under the gnu lesser general public license version 2.1"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2.0"),
    ("reserved", "all rights reserved"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
CONTAINMENT = Fraction(4, 5)
#: Templates are broadcast with the query; this many at most, of so many words.
MAX_TEMPLATES, MAX_TEMPLATE_WORDS = 10_000, 1_000

SEPARATORS = "".join(chr(c) for c in range(128) if not (chr(c).isdigit() or "a" <= chr(c) <= "z" or chr(c) in UPPER))
INLINE = SEPARATORS.replace("\n", "")


def need(size: int, share: Fraction = CONTAINMENT) -> int:
    """Words of a template of ``size`` words that a block must hold."""
    return max(1, ceil(share * size))


def normalised(text: str) -> Column:
    """Lower-cases A-Z and turns every other ASCII sign but digits, letters and line breaks into a blank."""
    return F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), UPPER + INLINE, LOWER + " " * len(INLINE))


def template_words(templates=TEMPLATES) -> list[tuple[str, list[str]]]:
    """Label and distinct words of each template, in order."""
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"more than {MAX_TEMPLATES} templates")
    blank = str.maketrans(UPPER + SEPARATORS, LOWER + " " * len(SEPARATORS))
    out = [(label, list(dict.fromkeys(text.translate(blank).split()))) for label, text in templates]
    if any(len(words) > MAX_TEMPLATE_WORDS for _, words in out):
        raise ValueError(f"a template with more than {MAX_TEMPLATE_WORDS} distinct words")
    return [(label, words) for label, words in out if words]


def strings(values) -> Column:
    return F.array(*map(F.lit, values)) if values else F.expr("CAST(array() AS array<string>)")


def words_by_frequency(texts: DataFrame, vocabulary: list[str]) -> list[str]:
    """The template words, those that the fewest documents hold first; ties and absent words by the word.

    One row per template word comes to the driver, whatever the corpus.
    """
    held = texts.select(F.explode(F.array_intersect(strings(vocabulary), F.split("norm", "[ \n]+"))).alias("word"))
    n = {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    return sorted(vocabulary, key=lambda w: (n.get(w, 0), w))


def prefix_index(spark: SparkSession, templates, order: list[str], share: Fraction) -> DataFrame:
    """``word, at, tokens, need, label``: the prefix words of every template with their position."""
    rank = {w: i for i, w in enumerate(order)}
    rows = []
    for label, words in templates:
        ranked = sorted(words, key=rank.__getitem__)
        a = need(len(ranked), share)
        rows += [(ranked[i], i, ranked, a, label) for i in range(len(ranked) - a + 1)]
    return spark.createDataFrame(rows, "word string, at int, tokens array<string>, need int, label string")


def block_matches(blocks: DataFrame, index: DataFrame) -> DataFrame:
    """``__row, block, label, containment`` of every block and template that meet the threshold.

    ``blocks`` has ``__row, block, known``: the block's template words in global order.
    """
    each = blocks.select("__row", "block", "known", F.posexplode("known").alias("place", "word"))
    hit = each.join(F.broadcast(index), "word").filter(
        (F.size("known") >= F.col("need"))
        & (1 + F.least(F.size("tokens") - F.col("at"), F.size("known") - F.col("place")) - 1 >= F.col("need"))
        # Only at the first word that both hold, so a pair is verified once.
        & ~F.arrays_overlap(F.slice("known", F.lit(1), F.col("place")), F.slice("tokens", F.lit(1), F.col("at")))
    )
    overlap = F.size(F.array_intersect("known", "tokens"))
    return hit.withColumn("overlap", overlap).filter(F.col("overlap") >= F.col("need")).select(
        "__row", "block", "label", (F.col("overlap") / F.size("tokens")).alias("containment")
    )


def phrase_places(flat: Column, phrase: str) -> tuple[Column, Column, Column]:
    """Count, first and last start (in words) of a phrase in words that are separated and surrounded by one blank."""
    inner, padded = f" {phrase}(?= )", f" {phrase} "
    blanks = lambda c: (F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))).cast("long")
    first = F.substring_index(flat, padded, 1)
    after_last = F.substring_index(F.reverse(flat), padded[::-1], 1)
    last = F.substring(flat, F.lit(1), F.length(flat) - F.length(after_last) - len(padded))
    has = F.contains(flat, F.lit(padded))
    return F.when(has, F.regexp_count(flat, F.lit(inner))).otherwise(0), F.when(has, blanks(first)), F.when(has, blanks(last))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, share: Fraction = CONTAINMENT) -> DataFrame:
    """``id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_blocks`` for every row.

    ``score`` is 1 where a base phrase stands, else the largest containment among matching blocks, else 0.  Null
    texts count as empty; repeated rows are scanned each; an empty table gives an empty result.
    """
    sized = template_words(templates)
    vocabulary = sorted({w for _, words in sized for w in words})
    texts = docs.select(F.col(id_col).cast("long").alias("id"), normalised(text_col).alias("norm"))
    order = words_by_frequency(texts, vocabulary)
    least = min((need(len(words), share) for _, words in sized), default=1)

    known = F.transform(F.split("norm", "\n"), lambda line, i: F.struct(i.alias("block"), F.array_intersect(strings(order), F.split(line, " ")).alias("known")))
    flat = F.concat(F.lit(" "), F.trim(F.regexp_replace("norm", "[ \n]+", " ")), F.lit(" "))
    prepared = texts.select("id", flat.alias("flat"), F.filter(known, lambda b: F.size(b["known"]) >= least).alias("blocks"))
    places = {label: phrase_places(F.col("flat"), phrase) for phrase, label in PHRASES.items()}
    some = [F.when(n > 0, F.lit(label)) for label, (n, _, _) in places.items()]
    counts = sum((n for n, _, _ in places.values()), F.lit(0)).cast("long")
    rows = keyed(prepared.select(
        "id", F.regexp_count("flat", F.lit("[^ ]+")).cast("long").alias("n_words"), counts.alias("n_base"),
        F.least(*(a for _, a, _ in places.values())).alias("first_word"), F.greatest(*(b for _, _, b in places.values())).alias("last_word"),
        F.array_compact(F.array(*some)).alias("base"), "blocks",
    ), "license-rows")

    blocks = rows.filter(F.size("blocks") > 0).select("__row", F.explode("blocks").alias("b")).select("__row", "b.block", "b.known")
    matches = block_matches(blocks, prefix_index(docs.sparkSession, sized, order, share))
    by_row = matches.groupBy("__row").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"), F.countDistinct("block").alias("n_blocks"))
    joined = rows.join(by_row, "__row", "left")
    every = F.array_sort(F.array_union("base", F.coalesce("more", strings([]))))
    return joined.select(
        "id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("base"), ",").alias("base_labels"), F.array_join(every, ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"), F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"),
    )


def _sql() -> str:
    words = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    rows = ", ".join(f"('{label}', {w}, {need(len(w))})" for label, w in template_words())
    place = " UNION ALL ".join(
        "SELECT doc_id, rn, '{}' AS label, i FROM (SELECT doc_id, rn, w, unnest(range(len(w))) AS i FROM words) WHERE {}".format(
            label, " AND ".join(f"w[i+{k + 1}] = '{p}'" for k, p in enumerate(phrase.split()))
        )
        for phrase, label in PHRASES.items()
    )
    return f"""WITH low AS (SELECT doc_id, row_number() OVER () AS rn, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
words AS (SELECT doc_id, rn, regexp_extract_all(t, '{words}') AS w FROM low),
templates AS (SELECT * FROM (VALUES {rows}) v(label, tw, need)),
place AS ({place}),
base AS (SELECT rn, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS bl FROM place GROUP BY rn),
lines AS (SELECT rn, unnest(string_split(t, chr(10))) AS l, unnest(range(len(string_split(t, chr(10))))) AS block FROM low),
sets AS (SELECT rn, block, list_distinct(regexp_extract_all(l, '{words}')) AS w FROM lines),
hits AS (SELECT rn, block, label, len(list_intersect(w, tw)) AS o, len(tw) AS n FROM sets, templates WHERE len(list_intersect(w, tw)) >= need),
more AS (SELECT rn, list(DISTINCT label) AS ml, max(o / n) AS best, count(DISTINCT block) AS n_blocks FROM hits GROUP BY rn)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
    array_to_string(list_sort(coalesce(bl, [])), ',') AS base_labels,
    array_to_string(list_sort(list_distinct(list_concat(coalesce(bl, []), coalesce(ml, [])))), ',') AS labels,
    CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0::DOUBLE) END AS score, coalesce(n_blocks, 0) AS n_blocks
FROM words LEFT JOIN base USING (rn) LEFT JOIN more USING (rn)"""


@query("op10_license_scan", _sql())
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
