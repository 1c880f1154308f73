"""License scan by diagonal voting: every run of `gram` words of every text is joined by its hash to its places in the
license templates; a match votes for its diagonal (place in the text less place in the template); the votes of
neighbouring diagonals, which insertions and deletions tear apart, are merged; the words under them are verified.

Words are runs of a-z, 0-9 and non-ASCII characters after lower-casing A-Z. Texts are cut into blocks of bounded
length with a margin, so that a long text is many rows and a match carries only the words that its template may cover.
Templates are broadcast while they have at most BROADCAST_GRAMS grams and are joined by shuffle beyond that; texts
never shuffle, only the words under a candidate do.

Null or empty texts have no words and no labels; texts shorter than a gram match nothing; rows of equal doc_id and text
get equal results, each its own row; a null doc_id is an id like any other; an empty table or no templates give no
spans; columns of docs other than doc_id and text are ignored. Templates of fewer than `gram` words are an error.
"""

from __future__ import annotations

import math
import zlib
from array import array

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import ddl, map_texts, staged, utf8_column
from .decontaminate import words_of

GRAM = 3
#: Of a template's words that must stand in a text; under ten words, all of them.
SHARE = 0.9
BLOCK = 1024
BROADCAST_GRAMS = 1_000_000

# Phrases whose exact places are reported, with their labels.
PHRASES = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]

# The usual notices and public license texts, with their labels.
NOTICES = [
    ("mit", "released under the MIT license"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("apache-2", "licensed under the Apache License, Version 2.0"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("gpl-3", "licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("cc-by-nc", "licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("all-rights-reserved", "all rights reserved"),
]

SPAN = "label string, template_id int, first_word bigint, last_word bigint, share double, exact boolean"


def template_table(spark: SparkSession, templates: list[tuple[str, str]] | None = None, gram: int = GRAM) -> DataFrame:
    """template_id, label and words (joined by spaces) of (label, text) pairs."""
    rows = [(i, label, " ".join(w.decode() for w in words_of(text.encode()))) for i, (label, text) in enumerate(PHRASES + NOTICES if templates is None else templates)]
    if short := [text for _, _, text in rows if len(text.split()) < gram]:
        raise ValueError(f"templates of fewer than {gram} words: {short}")
    return spark.createDataFrame(rows, "template_id int, label string, words string")


def gram_hashes(words: list[bytes], gram: int):
    """A 64-bit hash of each run of gram words."""
    import numpy as np

    if len(words) < gram:
        return np.zeros(0, np.int64)
    # Two checksums a word, so that unlike words seldom agree; what still agrees fails the comparison of words.
    low, high = (np.frombuffer(array("I", map(f, words)), np.uint32).astype(np.uint64) for f in (zlib.crc32, zlib.adler32))
    own = low | (high << np.uint64(32))
    out = np.zeros(len(words) - gram + 1, np.uint64)
    for i in range(gram):
        out = out * np.uint64(0x9E3779B97F4A7C15) + own[i : len(own) - gram + 1 + i]
    return (out ^ (out >> np.uint64(31))).view(np.int64)


def template_grams(templates: DataFrame, gram: int = GRAM) -> DataFrame:
    """hash, template_id, place, and of its template: its length and grams, a row for each gram of each template."""

    def cut(parts):
        for part in parts:
            out = [[] for _ in range(5)]
            for template, text in zip(part.column("template_id").to_pylist(), utf8_column(part, "words")):
                words = text.split()
                for place, h in enumerate(gram_hashes(words, gram).tolist()):
                    for column, value in zip(out, (h, template, place, len(words), len(words) - gram + 1)):
                        column.append(value)
            yield out

    return map_texts(templates.select("template_id", "words"), ddl("hash bigint, template_id int, place int, length int, grams int"), cut, "words")


def text_blocks(docs: DataFrame, margin: int, gram: int = GRAM, block: int = BLOCK) -> DataFrame:
    """doc_id, digest (a hash of the text), from_word, words (an array: the block's words with up to margin more on either side), lead (how many of these come before the block) and hashes of the block's grams."""
    keyed = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("digest"), "text")
    kind = keyed.schema["doc_id"].dataType.simpleString()

    def cut(parts):
        for part in parts:
            out = [[] for _ in range(6)]
            for doc_id, digest, text in zip(part.column("doc_id").to_pylist(), part.column("digest").to_pylist(), utf8_column(part, "text")):
                words = words_of(text)
                hashes = gram_hashes(words, gram)
                for start in range(0, len(hashes), block):
                    lead = min(start, margin)
                    row = doc_id, digest, start, b" ".join(words[start - lead : start + block + gram + margin]).decode(), lead, hashes[start : start + block].tolist()
                    for column, value in zip(out, row):
                        column.append(value)
                    if len(out[0]) >= 256:
                        yield out
                        out = [[] for _ in range(6)]
            yield out

    return map_texts(keyed, ddl(f"doc_id {kind}, digest bigint, from_word bigint, words string, lead int, hashes array<bigint>"), cut)


def tolerance(length, share: float):
    """(wrong, width) for templates of a length, a number or a column: how many words may be missing, and how many words of a text the rest may be spread over."""
    if isinstance(length, int):
        return math.floor(length * (1 - share) + 1e-9), math.floor(length / share + 1e-9)
    return F.floor(length * (1 - share) + 1e-9), F.floor(length / share + 1e-9)


def drift(length: int, share: float) -> int:
    """How far apart the diagonals of one verified place can lie."""
    wrong, width = tolerance(length, share)
    return width - length + 2 * wrong


def diagonal_votes(docs: DataFrame, templates: DataFrame, share: float = SHARE, gram: int = GRAM, block: int = BLOCK) -> DataFrame:
    """doc_id, digest, template_id, length, grams, diagonal, votes (different places of the template that match there), slack, under (the words the template may cover, slack more on either side) and under_from (the number of the first of these)."""
    grams = template_grams(templates, gram)
    size = grams.agg(F.count("*").alias("n"), F.max("length").alias("longest")).first()
    slack = drift(size.longest or gram, share)
    if size.n <= BROADCAST_GRAMS:
        grams = F.broadcast(grams)
    blocks = text_blocks(docs, (size.longest or gram) + slack, gram, block)
    hits = blocks.select("doc_id", "digest", "from_word", "lead", "words", F.posexplode("hashes").alias("at", "hash")).join(grams, "hash")
    # Only rows that match get here: what lies under the template is cut out of the block's words.
    start = F.col("lead") + F.col("at") - F.col("place") - slack
    first = F.greatest(F.lit(0), start)
    under = F.array_join(F.slice(F.split("words", " "), first + 1, F.greatest(F.lit(0), start + F.col("length") + 2 * slack - first)), " ")
    cut = hits.select(
        "doc_id", "digest", "template_id", "length", "grams", "place", (F.col("from_word") + F.col("at") - F.col("place")).alias("diagonal"),
        under.alias("under"), (F.col("from_word") - F.col("lead") + first).alias("under_from"),
    )
    # A diagonal that crosses blocks has the same words under it in both, as the margin covers every template.
    key = ["doc_id", "digest", "template_id", "length", "grams", "diagonal", "under", "under_from"]
    return cut.groupBy(*key).agg(F.size(F.collect_set("place")).alias("votes")).withColumn("slack", F.lit(slack))


def merged_diagonals(votes: DataFrame, slack: int, share: float = SHARE, gram: int = GRAM) -> DataFrame:
    """The diagonals of votes that may be right, with merged, the votes of all diagonals within slack.

    Each missing word costs at most `gram` votes, each word in between `gram` - 1: what has fewer merged votes than
    that leaves can't reach the share.
    """
    near = Window.partitionBy("doc_id", "digest", "template_id").orderBy("diagonal").rangeBetween(-slack, slack)
    wrong, width = tolerance(F.col("length"), share)
    least = F.col("grams") - gram * wrong - (gram - 1) * (width - F.col("length") + wrong)
    return votes.withColumn("merged", F.sum("votes").over(near)).filter(F.col("merged") >= F.greatest(F.lit(1), least))


def common_in_order(words: list[str], template: list[str]) -> tuple[int, int, int]:
    """How many words of template stand in words in order (longest common subsequence), and the first and last place of a choice that starts late and ends early."""
    best = [(0, 0, 0)] * (len(template) + 1)  # of the first j words of template: matches, start, minus the end
    for i, w in enumerate(words):
        before = best[0]
        for j, t in enumerate(template, 1):
            kept = best[j]
            if w == t:
                best[j] = max(kept, (before[0] + 1, before[1] if before[0] else i, -i))
            best[j] = max(best[j], best[j - 1])
            before = kept
    n, start, end = best[-1]
    return n, start, -end


def placed(words: list[str], template: list[str], share: float) -> tuple[int, int, int] | None:
    """(matches, first, last) where enough words of template stand in order within the width allowed, or None; the most matches, then the earliest."""
    wrong, width = tolerance(len(template), share)
    least = len(template) - wrong
    whole = common_in_order(words, template)
    if whole[0] < least or whole[2] - whole[1] < width:
        return whole if whole[0] >= least else None
    found = [(n, -(at + first), at + last) for at in range(max(1, len(words) - width + 1)) for n, first, last in [common_in_order(words[at : at + width], template)] if n >= least]
    return (max(found)[0], -max(found)[1], max(found)[2]) if found else None


def verified_spans(candidates: DataFrame, templates: DataFrame, share: float = SHARE) -> DataFrame:
    """doc_id, digest and SPAN's columns of the candidates whose words are the template's: all of them on the diagonal (exact), or at least share of them in order within 1/share of its length."""
    wanted = F.broadcast(templates) if small(templates) else templates
    rows = candidates.select("doc_id", "digest", "template_id", "diagonal", "under", "under_from").join(wanted, "template_id")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def check(parts):
        for part in parts:
            out = [[] for _ in range(8)]
            columns = [part.column(c).to_pylist() for c in ("doc_id", "digest", "template_id", "diagonal", "under", "under_from", "label", "words")]
            for doc_id, digest, template_id, diagonal, under, start, label, words in zip(*columns):
                found, template = under.split(" "), words.split(" ")
                at = diagonal - start
                exact = at >= 0 and found[at : at + len(template)] == template
                if place := (len(template), at, at + len(template) - 1) if exact else placed(found, template, share):
                    row = doc_id, digest, label, template_id, start + place[1], start + place[2], place[0] / len(template), exact
                    for column, value in zip(out, row):
                        column.append(value)
            yield out

    found = map_texts(rows, ddl(f"doc_id {kind}, digest bigint, {SPAN}"), check, "under")
    return found.groupBy("doc_id", "digest", "label", "template_id", "first_word", "last_word").agg(F.max("share").alias("share"), F.max("exact").alias("exact"))


def small(templates: DataFrame, most: int = 10_000) -> bool:
    """Whether the templates may be sent to every task."""
    return templates.limit(most + 1).count() <= most


def license_spans(docs: DataFrame, templates: DataFrame | None = None, share: float = SHARE, gram: int = GRAM, block: int = BLOCK) -> DataFrame:
    """doc_id, digest and SPAN's columns: the places of each text where a template's words stand, from first_word to last_word."""
    templates = template_table(docs.sparkSession, gram=gram) if templates is None else templates
    votes = staged(diagonal_votes(docs, templates, share, gram, block), "votes")
    slack = votes.select("slack").first()
    return verified_spans(merged_diagonals(votes, slack[0] if slack else 0, share, gram), templates, share)


def scan_licenses(docs: DataFrame, phrases: list[tuple[str, str]] = PHRASES, notices: list[tuple[str, str]] = NOTICES, share: float = SHARE, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word and base_labels (exact places of phrases), labels (of all verified templates), score (the largest verified share; 0 without) of every row of docs."""
    spark = docs.sparkSession
    spans = license_spans(docs, template_table(spark, [*phrases, *notices], gram), share, gram)
    base = F.col("exact") & (F.col("template_id") < len(phrases))
    labels = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    told = spans.groupBy(F.col("doc_id").alias("span_id"), F.col("digest").alias("span_digest")).agg(
        F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("first_word"))).alias("first_word"), F.max(F.when(base, F.col("first_word"))).alias("last_word"),
        labels(F.when(base, F.col("label"))).alias("base_labels"), labels("label").alias("labels"), F.max("share").alias("score"),
    )
    keyed = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("digest"), "text")
    kind = keyed.schema["doc_id"].dataType.simpleString()

    def count(parts):
        for part in parts:
            yield [part.column("doc_id"), part.column("digest"), [len(words_of(t)) for t in utf8_column(part, "text")]]

    counted = map_texts(keyed, ddl(f"doc_id {kind}, digest bigint, n_words bigint"), count)
    both = counted.join(told, F.col("doc_id").eqNullSafe(F.col("span_id")) & (F.col("digest") == F.col("span_digest")), "left")
    zero = {"n_base": 0, "base_labels": "", "labels": "", "score": 0.0}
    return both.select("doc_id", "n_words", *[F.coalesce(c, F.lit(zero[c])).alias(c) if c in zero else F.col(c) for c in ("n_base", "first_word", "last_word", "base_labels", "labels", "score")])
