"""License scan: an exact set-similarity join of text blocks with licence templates (operator 9).

A block is a line of a text together with the words that follow it, one fewer than the longest template
has: a notice that begins in the line is in its block whole, however it is wrapped. A block matches a template when it
holds at least ``threshold`` of the template's distinct words, and the words that tell it from its
neighbours (``REQUIRED``). Template words are put in order of their document frequency over all
texts, rarest first. A block that reaches the threshold must hold one of a template's first
words in that order (prefix filter), must have enough words (length filter), and from the first
shared word on both sides must have enough words left (positional filter). Blocks that pass are
checked on the full sets. Every template at the threshold counts. Phrase places are counted beside it.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Characters that separate words, upper-case and lower-case letters of ASCII.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
IN_LINE = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]++"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Phrases that always label a text.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Sentences of the usual notices of public licences, by label.
TEMPLATES = [
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is "
               "distributed on an AS IS BASIS, without warranties or conditions of any kind"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("bsd-3", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
              "products derived from this software without specific prior written permission"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related rights to this work"),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
            "Public License as published by the Free Software Foundation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
            "the Software"),
    ("mit", "Released under the MIT License"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]
#: Words without which a label's templates, few words apart from another licence's, don't match.
REQUIRED = {"agpl": "affero", "cc-by-nc": "nc", "cc-by-sa": "sa", "epl": "eclipse", "lgpl": "lesser", "mpl": "mozilla"}
THRESHOLD = 0.8


def words_of(text: Column) -> Column:
    """Words of a text, A-Z lower-cased."""
    return F.filter(F.split(F.translate(text, UPPER, LOWER), SEPARATORS), lambda w: w != "")


def template_words(templates=None) -> list[tuple[int, str, list[str]]]:
    """(number, label, distinct words) of each template."""
    out = []
    for k, (label, text) in enumerate(TEMPLATES if templates is None else templates):
        low = "".join(c if c.isalnum() else " " for c in text).lower()
        out.append((k, label, sorted(set(low.split()))))
    return [t for t in out if t[2]]


def required_words(label: str, words: list[str]) -> list[str]:
    """Words of a template that its block must hold: the label's own in ``REQUIRED``, or the label where the template has it."""
    return [w for w in words if w in (REQUIRED.get(label), label)]


def reach(templates=None) -> int:
    """Words that follow a line in its block: one fewer than the longest template has."""
    texts = [t for _, t in (TEMPLATES if templates is None else templates)]
    return max((len("".join(c if c.isalnum() else " " for c in t).split()) for t in texts), default=1) - 1


def needed(size: int, threshold: float) -> int:
    """Shared words a template of ``size`` words asks for: the least n with n / size >= threshold."""
    return next(n for n in range(1, size + 1) if n / size >= threshold)


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def texts_of(docs: DataFrame, text_col: str, keys: list[Column], vocabulary: list[str], least: int, *more: Column) -> DataFrame:
    """(keys, _held, _text, more) of every text, written once: the template words it holds, and the text where these are ``least`` or more."""
    words = words_of(F.col(text_col))
    split = docs.select(*keys, F.col(text_col).alias("_whole"), F.inline(F.array(F.struct(words.alias("_words")))))
    held = F.array_intersect(_strings(vocabulary), F.col("_words"))
    seen = split.select(*split.columns, F.inline(F.array(F.struct(held.alias("_held")))))
    return cut_lineage(seen.select(*split.columns[:-2], "_held", *more,
                                   F.when(F.size("_held") >= least, F.col("_whole")).alias("_text")))


def word_order(texts: DataFrame, vocabulary: list[str]) -> list[str]:
    """Template words from the rarest to the most frequent over all texts (ties by the word).

    The counts are summed on the executors; as many rows as there are template words come back.
    """
    seen = texts.select(F.explode("_held").alias("w")).groupBy("w").count()
    count = {r["w"]: r["count"] for r in seen.collect()}
    return sorted(vocabulary, key=lambda w: (count.get(w, 0), w))


def blocks_of(texts: DataFrame, names: list[str], order: list[str], after: int, least: int) -> DataFrame:
    """One row a block that holds ``least`` template words or more: the keys and these words in the common order (_held)."""
    low = F.regexp_replace(F.translate(F.col("_text"), UPPER, LOWER), IN_LINE, " ")
    # between two words stands one line feed at most
    tokens = F.filter(F.split(F.regexp_replace(low, r"(?: ?\n)++ ?", " \n "), " "), lambda w: w != "")
    t = texts.where(F.col("_text").isNotNull()).select(*names, F.inline(F.array(F.struct(tokens.alias("_tokens")))))
    feeds = F.filter(F.sequence(F.lit(1), F.size("_tokens")), lambda i: F.get("_tokens", i - 1) == "\n")
    t = t.select(*names, "_tokens", F.inline(F.array(F.struct(feeds.alias("_feeds")))))
    ends = F.concat("_feeds", F.array(F.size("_tokens") + 1))

    def block(end: Column, at: Column) -> Column:
        start = F.coalesce(F.get("_feeds", at - 1), F.lit(0)) + 1
        behind = F.filter(F.slice("_tokens", end, 2 * after), lambda w: w != "\n")
        return F.array_intersect(_strings(order), F.concat(F.slice("_tokens", start, end - start), F.slice(behind, 1, after)))
    blocks = F.filter(F.transform(ends, block), lambda b: F.size(b) >= least)
    return t.select(*names, F.explode(blocks).alias("_held"))


def hits_of(texts: DataFrame, names: list[str], chosen: list[tuple[int, str, list[str]]], threshold: float, after: int) -> DataFrame:
    """(keys, label, score) of every template that a block of ``texts`` (of ``texts_of``) matches, with its best containment."""
    vocabulary = sorted({w for _, _, ws in chosen for w in ws})
    order = word_order(texts, vocabulary)
    rank = {w: k for k, w in enumerate(order)}

    # the index: each template's prefix words, with the words of the template that come after
    rows = []
    for number, label, ws in chosen:
        ranked = sorted(ws, key=rank.__getitem__)
        least = needed(len(ranked), threshold)
        rows += [(w, number, label, least, len(ranked) - at - 1, ranked, required_words(label, ranked))
                 for at, w in enumerate(ranked[:len(ranked) - least + 1])]
    index = texts.sparkSession.createDataFrame(
        rows, "word string, number int, label string, least int, after int, template array<string>, must array<string>")
    prefix_words = sorted({r[0] for r in rows})
    held = blocks_of(texts, names, order, after, min(r[3] for r in rows))
    held = held.select(*names, "_held", F.explode(F.array_intersect("_held", _strings(prefix_words))).alias("word"))
    # the templates are a parameter: the index has at most one row for each of their words
    j = held.join(F.broadcast(index), "word")
    left_in_block = F.size("_held") - F.array_position("_held", F.col("word"))
    j = j.where((F.size("_held") >= F.col("least")) & (1 + F.least("after", left_in_block) >= F.col("least")))
    shared = F.size(F.array_intersect("template", "_held"))
    j = j.where(F.size(F.array_except("must", "_held")) == 0) \
        .select(*names, "label", "least", shared.alias("_shared"), F.size("template").alias("_all")) \
        .where(F.col("_shared") >= F.col("least"))
    return j.groupBy(*names, "label").agg(F.max(F.col("_shared") / F.col("_all")).alias("score"))


def license_hits(docs: DataFrame, text_col: str = "text", keys: dict[str, Column] | None = None, templates=None,
                 threshold: float = THRESHOLD) -> DataFrame:
    """(keys, label, score) of every template a text holds, with the best containment over the text's blocks."""
    chosen = template_words(templates)
    names = list(keys or {"doc_id": None})
    key_cols = [c.alias(k) for k, c in (keys or {"doc_id": F.col("doc_id")}).items()]
    if not chosen:
        return docs.select(*key_cols, F.lit("").alias("label"), F.lit(0.0).alias("score")).limit(0)
    vocabulary = sorted({w for _, _, ws in chosen for w in ws})
    texts = texts_of(docs, text_col, key_cols, vocabulary, min(needed(len(ws), threshold) for _, _, ws in chosen))
    return hits_of(texts, names, chosen, threshold, reach(templates))


def phrase_places(words: Column, phrases: dict[str, str]) -> Column:
    """array<struct<at int, label string>>: every place where a phrase's words stand consecutively."""
    nothing = F.array().cast("array<struct<at:int,label:string>>")

    def of(parts: list[str], label: str) -> Column:
        stands = lambda i: _all([F.get(words, i + k) == F.lit(p) for k, p in enumerate(parts)])
        at = F.filter(F.sequence(F.lit(0), F.size(words) - len(parts)), stands)
        here = F.transform(at, lambda i: F.struct(i.alias("at"), F.lit(label).alias("label")))
        return F.coalesce(F.when((F.size(words) >= len(parts)) & F.array_contains(words, parts[0]), here), nothing)
    return F.concat(nothing, *[of(phrase.split(" "), label) for phrase, label in phrases.items()])


def _all(conditions):
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=None, templates=None,
                  threshold: float = THRESHOLD) -> DataFrame:
    """Licence labels of every whole text, one row per row of ``docs``.

    n_words; n_base, first_word and last_word (places of the base phrases; null without one);
    base_labels and labels (distinct, sorted, comma-joined; labels has the templates' too); score:
    1 with a base phrase, else the best containment, else 0. A null text is empty. Rows with the same
    id and text get the same result; null ids are kept. Other columns are not read. Texts are split into words
    once; only those that hold enough template words for one of the templates are cut into blocks. Hits are
    grouped by (id, hash of the text), so no group grows with the corpus.
    """
    phrases = BASE_PHRASES if phrases is None else phrases
    chosen = template_words(templates)
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_hash"), text.alias("_text"))
    vocabulary = sorted({w for _, _, ws in chosen for w in ws})
    least = min((needed(len(ws), threshold) for _, _, ws in chosen), default=1)
    base = texts_of(keyed, "_text", [F.col("_id"), F.col("_hash")], vocabulary, least, F.size("_words").alias("_n"),
                    phrase_places(F.col("_words"), phrases).alias("_places"))
    if chosen:
        hits = hits_of(base, ["_id", "_hash"], chosen, threshold, reach(templates)) \
            .groupBy("_id", "_hash").agg(F.collect_set("label").alias("_found"), F.max("score").alias("_best"))
    else:
        hits = base.select("_id", "_hash", F.lit(None).cast("array<string>").alias("_found"), F.lit(0.0).alias("_best")).limit(0)
    j = base.select("_id", "_hash", "_n", "_places").join(
        hits.withColumnsRenamed({"_id": "_hid", "_hash": "_hhash"}),
        F.col("_id").eqNullSafe(F.col("_hid")) & (F.col("_hash") == F.col("_hhash")), "left")
    labels = F.transform("_places", lambda p: p["label"])
    at = F.transform("_places", lambda p: p["at"])
    joined = F.concat(labels, F.coalesce("_found", F.array().cast("array<string>")))
    return j.select(
        F.col("_id").alias(id_col), F.col("_n").cast("long").alias("n_words"),
        F.size("_places").cast("long").alias("n_base"),
        F.array_min(at).cast("long").alias("first_word"), F.array_max(at).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(labels)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(joined)), ",").alias("labels"),
        F.when(F.size("_places") > 0, F.lit(1.0)).otherwise(F.coalesce("_best", F.lit(0.0))).alias("score"))
