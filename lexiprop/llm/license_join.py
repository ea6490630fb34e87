"""License scan: an exact set-similarity join of text blocks with license notices (DataFrame operations only).

Templates are notices of up to 32 words. A template of class ``s`` (8, 16 or 32 words) is sought in
blocks of ``2 s`` words that start at every ``s``-th word, so that a passage of up to ``s`` words
lies whole in a block. A block matches a template if it holds at least ``THRESHOLD`` of the
template's distinct words (containment), which is decided exactly:

* the words of all templates are ordered by how often the corpus has them, rarest first; words
  of no template can't match and are left out of the blocks' sets;
* prefix filter: of a template of m words that needs a, one of the first m - a + 1 must be in the
  block, and stand among the block's first b - a + 1 (b: its size);
* length filter: b >= a;
* positional filter: the words from the shared one on must suffice, in the template and the block;
* what passes is counted in full.

Blocks without any template's prefix word are never built. Phrases of the base rules are found
apart, as words that stand in a row.

Defined cases: null and empty texts have no words, blocks or labels and score 0; rows equal in all
columns and rows without a doc_id each come out; words that are equally frequent are ordered
by name; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiprop.llm.common import ascii_lower, column, let, stored

#: What stands between words.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
THRESHOLD = 0.8
CLASSES = (8, 16, 32)

# Phrases and labels of the contract.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Labels and opening words of published license notices.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("proprietary", "unauthorized copying of this file via any medium is strictly prohibited proprietary and confidential"),
]


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NO_WORD), "")


def _strings(values: list[str]) -> Column:
    return F.split(F.lit(" ".join(values)), " ") if values else F.array().cast("array<string>")


class Templates:
    """The templates' word sets in the corpus' order, rarest first, and what each filter needs of them."""

    def __init__(self, counts: dict[str, int], templates=TEMPLATES, threshold: float = THRESHOLD):
        self.order = sorted({w for _, t in templates for w in t.split()}, key=lambda w: (counts.get(w, 0), w))
        at = {w: i for i, w in enumerate(self.order)}
        self.rows = []  # (template, label, span, words in order, least overlap)
        for i, (label, text) in enumerate(templates):
            own = sorted(set(text.split()), key=at.get)
            span = next(s for s in CLASSES if len(text.split()) <= s)
            self.rows.append((i, label, span, own, ceil(round(threshold * len(own), 9))))

    def spans(self) -> list[int]:
        return sorted({r[2] for r in self.rows})

    def prefix(self, span: int) -> list[str]:
        """Words of which a block must hold one to match any template of the class."""
        return [w for w in self.order if any(r[2] == span and w in r[3][: len(r[3]) - r[4] + 1] for r in self.rows)]

    def least(self, span: int) -> int:
        return min(r[4] for r in self.rows if r[2] == span)

    def index(self, like: DataFrame) -> DataFrame:
        """``(span, token, place, template, label, members, least)`` for each prefix word of each template."""
        rows = [(span, w, i, t, label, own, least) for t, label, span, own, least in self.rows for i, w in enumerate(own[: len(own) - least + 1])]
        schema = "span int, token string, place int, template int, label string, members array<string>, least int"
        return like.sparkSession.createDataFrame(rows, schema)


def template_counts(docs: DataFrame, templates=TEMPLATES) -> dict[str, int]:
    """How often the corpus has each word of the templates (some hundred numbers)."""
    known = sorted({w for _, t in templates for w in t.split()})
    tokens = docs.select(F.explode(words(column(docs, "text", "string"))).alias("w")).filter(F.col("w").isin(known))
    return {r["w"]: r["count"] for r in tokens.groupBy("w").count().collect()}


def places(w: Column) -> Column:
    """``[(at, label), ...]``: where a phrase's words stand in a row."""
    found = F.lit(None).cast("string")
    starts = []

    def here(x: Column, i: Column) -> Column:
        hit = F
        for phrase, label in PHRASES.items():
            first, *rest = phrase.split()
            same = x == first
            for k, word in enumerate(rest, 1):
                same = same & (F.get(w, i + k) == word)
            hit = hit.when(same, F.lit(label))
        return F.struct(i.cast("long").alias("at"), hit.otherwise(found).alias("label"))

    starts = F.filter(F.transform(w, here), lambda p: p["label"].isNotNull())
    gate = F.arrays_overlap(w, _strings([p.split()[0] for p in PHRASES]))
    return F.when(gate, starts).otherwise(F.array().cast("array<struct<at:bigint,label:string>>"))


def blocks(w: Column, known: Templates) -> Column:
    """``[(span, start, tokens), ...]``: blocks with a prefix word and enough template words, in the templates' order."""
    kind = "array<struct<span:int,start:int,tokens:array<string>>>"

    def of_class(hits: Column, span: int) -> Column:
        mine = F.filter(hits, lambda h: h["w"].isin(known.prefix(span)))
        near = F.flatten(F.transform(mine, lambda h: F.array(F.floor(h["i"] / span), F.floor(h["i"] / span) - 1)))
        starts = F.filter(F.array_distinct(near), lambda b: b >= 0)
        # array_intersect keeps the order of its first array
        held = lambda b: F.array_intersect(_strings(known.order), F.slice(w, (b * span + 1).cast("int"), F.lit(2 * span)))
        built = F.transform(starts, lambda b: F.struct(F.lit(span).alias("span"), (b * span).cast("int").alias("start"), held(b).alias("tokens")))
        return F.filter(built, lambda b: F.size(b["tokens"]) >= known.least(span))

    any_prefix = sorted({t for s in known.spans() for t in known.prefix(s)})
    hits = F.filter(F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("i"))), lambda h: h["w"].isin(any_prefix))
    found = let(hits, lambda h: F.concat(*[of_class(h, s) for s in known.spans()]))
    return F.when(F.arrays_overlap(w, _strings(any_prefix)), found).otherwise(F.array().cast(kind)).cast(kind)


def scanned(docs: DataFrame, known: Templates) -> DataFrame:
    """``(row, doc_id, n_words, places, blocks)`` of every row, stored; ``row`` names a row of ``docs``."""

    def read(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), places(w).alias("places"), blocks(w, known).alias("blocks"))

    seen = docs.select(F.monotonically_increasing_id().alias("row"), column(docs, "doc_id", "long").alias("doc_id"), let(words(column(docs, "text", "string")), read).alias("m"))
    return stored(seen.select("row", "doc_id", "m.*"), "license-blocks")


def matching_blocks(rows: DataFrame, known: Templates) -> DataFrame:
    """The join: ``(row, span, start, template, label, overlap, containment)`` for every block of ``rows``
    (as ``scanned`` gives them) that meets the threshold of a template."""
    each = rows.select("row", F.explode("blocks").alias("b")).select("row", "b.*")
    least = F
    for span in known.spans():
        least = least.when(F.col("span") == span, F.lit(known.least(span)))
    size = F.size("tokens")
    prefixes = each.withColumn("least_any", least).select(
        "row", "span", "start", "tokens", F.posexplode(F.slice("tokens", F.lit(1), size - F.col("least_any") + 1)).alias("at", "token")
    )
    index = known.index(rows)  # as many rows as the templates have prefix words
    shared = prefixes.join(F.broadcast(index), ["span", "token"])
    long_enough = size >= F.col("least")
    in_prefix = F.col("at") <= size - F.col("least")
    rest_enough = F.least(F.size("members") - F.col("place"), size - F.col("at")) >= F.col("least")
    overlap = F.size(F.array_intersect("members", "tokens"))
    counted = shared.filter(long_enough & in_prefix & rest_enough).withColumn("overlap", overlap).filter("overlap >= least")
    share = (F.col("overlap") / F.size("members")).alias("containment")
    return counted.select("row", "span", "start", "template", "label", "overlap", share).distinct()


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)`` for every row of ``docs``.

    ``score`` is the largest containment of a template in a block that matches; 1 where a phrase stands.
    """
    known = Templates(template_counts(docs, templates), templates, threshold)
    rows = scanned(docs, known)
    found = matching_blocks(rows, known).groupBy("row").agg(F.collect_set("label").alias("found"), F.max("containment").alias("best"))
    base = F.array_distinct(F.col("places.label"))
    at = F.col("places.at")
    named = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    score = F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0)))
    return rows.drop("blocks").join(found, "row", "left").select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(at).alias("first_word"),
        F.array_max(at).alias("last_word"),
        named(base).alias("base_labels"),
        named(F.concat(base, F.coalesce("found", F.array().cast("array<string>")))).alias("labels"),
        F.round(score, 9).alias("score"),
    )
