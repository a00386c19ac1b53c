"""License scans: fixed phrases, and an exact containment join of text blocks with license templates.

A block is any run of consecutive words, across lines, of a template's length over ``THRESHOLD`` (rounded up), so a notice
that is wrapped over lines is found as one on a single line is. A template is found in a block that has at least ``THRESHOLD`` of its
distinct words, among them those it can't do without (``required``).

Texts are cut into overlapping chunks, so that every block lies in one chunk as a whole, and the join finds candidates
by chunk. Words are ordered by their frequency in all texts, rarest first. A pair that meets the threshold must share one
of the template's first |T| - need + 1 words (need: the words asked for) and one of the chunk's first words likewise
(prefix filter); a chunk needs ``need`` template words at all (length filter); and after the first shared word
enough words must remain on both sides (positional filter). In what passes, every block is counted in full.

Everything is DataFrame expressions. Templates are constants, so their words (a few hundred) can be held by every task.

Defined cases: a null or empty text has no words, no places and score 0; very long texts are many chunks of bounded size;
repeated rows each get a result (rows with equal id and text get equal ones); null ids are kept; columns besides id and
text are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Between words: all ASCII characters but digits and (lower-case) letters.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

THRESHOLD = 0.8
#: Opening or naming sentences of common licenses (public texts).
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("apache-2", "You may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]


def words(text: Column) -> Column:
    """The lower-cased words of a text as an array."""
    folded = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(folded, BREAKS), lambda w: w != "")


def once(value: Column) -> Column:
    """The same value as a generator's output, which the planner does not compute again in each filter and column that uses it."""
    return F.explode(F.array(value))


def _words(text: str) -> list[str]:
    return [w for w in re.split(BREAKS, text.translate(str.maketrans(UPPER, LOWER))) if w]


def phrase_places(found: Column, joined: Column, phrase: str) -> Column:
    """Where the words of a phrase stand in the array ``found``; ``joined`` is the array as one text, with a space before and after."""
    parts = phrase.split(" ")
    return F.when(
        joined.contains(f" {phrase} "),
        F.filter(F.sequence(F.lit(0), F.size(found) - len(parts)), lambda i: F.slice(found, i + 1, len(parts)) == F.array(*map(F.lit, parts))),
    ).otherwise(F.array().cast("array<int>"))


def required(templates: list[tuple[str, str]], threshold: float = THRESHOLD) -> list[set[str]]:
    """The words each template can't do without.

    These are the parts of its label's name that it has, and, where the text of another label's template would meet the
    threshold too, the words that tell the two apart.
    """
    sets = [{*_words(t)} for _, t in templates]
    out = []
    for (label, _), t in zip(templates, sets):
        must = {*_words(label)} & t
        for (other, _), u in zip(templates, sets):
            if other != label and len(t & u) >= math.ceil(threshold * len(t)):
                must |= t - u
        out.append(must)
    return out


def span(template: str, threshold: float = THRESHOLD) -> int:
    """How many words a block has that is compared with the template."""
    return math.ceil(len(_words(template)) / threshold)


def _frequency_order(docs: DataFrame, text_col: str, vocabulary: list[str]) -> list[str]:
    """The template words, rarest in all texts first."""
    seen = docs.select(F.explode(F.filter(words(F.col(text_col)), lambda w: w.isin(vocabulary))).alias("word")).groupBy("word").count()
    count = {r["word"]: r["count"] for r in seen.collect()}  # at most the templates' words
    return sorted(vocabulary, key=lambda w: (count.get(w, 0), w))


def template_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(id, text_key, chunk, template, label, containment) of every chunk and template with a block that meets the threshold.

    ``containment`` is that of the chunk's best block.
    """
    spark: SparkSession = docs.sparkSession
    sets = [sorted({*_words(t)}) for _, t in templates]
    order = {w: i for i, w in enumerate(_frequency_order(docs, text_col, sorted({w for s in sets for w in s})))}
    constants, index = [], []
    for k, ((label, text), s, must) in enumerate(zip(templates, sets, required(templates, threshold))):
        ranks = sorted(order[w] for w in s)
        need = math.ceil(threshold * len(ranks))
        constants.append((k, label, ranks, sorted(order[w] for w in must), need, span(text, threshold)))
        index += [(rank, k, j) for j, rank in enumerate(ranks[: len(ranks) - need + 1])]
    least = min(need for *_, need, _ in constants)
    stride = max(width for *_, width in constants)

    def constant(rows: list[tuple], *names: str) -> DataFrame:
        def cell(value) -> Column:
            return F.array(*map(F.lit, value)).cast("array<int>") if isinstance(value, list) else F.lit(value)

        return spark.range(1).select(F.inline(F.array(*(F.struct(*(cell(v).alias(n) for n, v in zip(names, row))) for row in rows))))

    known = constant(constants, "template", "label", "ranks", "musts", "need", "width")
    prefixes = constant(index, "rank", "template", "place_there")
    rank_of = F.create_map(*(F.lit(x) for pair in order.items() for x in pair))
    first = {rank for rank, *_ in index}
    first_words = [w for w, r in order.items() if r in first]

    split = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), once(words(F.col(text_col))).alias("words"))
    starts = F.sequence(F.lit(0), F.floor((F.size("words") - 1) / stride).cast("int"))
    chunks = (
        split.where(F.exists("words", lambda w: w.isin(first_words)))
        .select("id", "text_key", F.posexplode(F.transform(starts, lambda j: F.slice("words", j * stride + 1, 2 * stride))).alias("chunk", "words"))
        .where(F.exists("words", lambda w: w.isin(first_words)))
    )
    ranked = F.transform("words", lambda w, i: F.struct(i.alias("at"), F.try_element_at(rank_of, w).alias("rank")))
    hits = chunks.select("id", "text_key", "chunk", once(F.filter(ranked, lambda h: h["rank"].isNotNull())).alias("hits"))
    sets_of = hits.select("*", once(F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["rank"])))).alias("has")).where(F.size("has") >= least)
    probes = sets_of.select("*", F.posexplode(F.slice("has", 1, F.size("has") - least + 1)).alias("place", "rank"))
    met = (
        probes.join(F.broadcast(prefixes), "rank")
        .groupBy("id", "text_key", "chunk", "hits", "has", "template")
        .agg(F.min("place").alias("place"), F.min("place_there").alias("place_there"))
    )
    left = F.least(F.size("has") - F.col("place"), F.size("ranks") - F.col("place_there"))
    likely = (
        met.join(F.broadcast(known), "template")
        .where((F.size("has") >= F.col("need")) & (left >= F.col("need")))
        .where(F.size(F.array_intersect("has", "ranks")) >= F.col("need"))
        .withColumn("own", once(F.filter("hits", lambda h: F.array_contains("ranks", h["rank"]))))
    )

    def block(start: Column) -> Column:
        inside = F.filter("own", lambda g: (g["at"] >= start["at"]) & (g["at"] < start["at"] + F.col("width")))
        return F.array_distinct(F.transform(inside, lambda g: g["rank"]))

    enough = F.filter(F.transform("own", block), lambda b: (F.size(b) >= F.col("need")) & (F.size(F.array_except("musts", b)) == 0))
    most = likely.withColumn("common", once(F.array_max(F.transform(enough, lambda b: F.size(b)))))
    return most.where("common is not null").select("id", "text_key", "chunk", "template", "label", (F.col("common") / F.size("ranks")).alias("containment"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Each document with ``n_words``, the places of each phrase, ``base_labels``, ``labels`` and ``score``.

    ``score`` is the largest containment of a template in a block of the document, 0 if none meets the threshold.
    """
    found = template_pairs(docs, id_col, text_col, templates, threshold).groupBy("id", "text_key").agg(F.collect_set("label").alias("more"), F.max("containment").alias("score"))
    split = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), once(words(F.col(text_col))).alias("words"))
    joined = split.withColumn("joined", F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")))
    places = joined.select("id", "text_key", F.size("words").cast("long").alias("n_words"), *(phrase_places(F.col("words"), F.col("joined"), p).alias(f"p{i}") for i, p in enumerate(PHRASES)))
    at = F.concat(*(f"p{i}" for i in range(len(PHRASES))))
    base = F.array_compact(F.array(*(F.when(F.size(f"p{i}") > 0, F.lit(label)) for i, label in enumerate(PHRASES.values()))))
    counted = places.select("id", "text_key", "n_words", at.alias("places"), F.array_sort(F.array_distinct(base)).alias("base"))
    same = counted["id"].eqNullSafe(found["id"]) & (counted["text_key"] == found["text_key"])
    return counted.join(found, same, "left").select(
        counted["id"].alias(id_col), "n_words", "places", F.col("base").alias("base_labels"),
        F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>")))).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
