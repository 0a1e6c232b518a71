"""License scan by an exact set-similarity join, with DataFrame functions only.

A template is a notice as a set of words. A text block is a run of words, across line ends, as long as the notice and a
quarter more; it matches when it holds at least `threshold` of the notice's distinct words. The join over all blocks of
all texts is exact: words that no template has cannot add overlap, so a text keeps only the places of template words; all
template words are ordered by their frequency over all texts, rarest first; a match must hold one of the first
n - need + 1 words of the template, and is looked for where its first one stands (prefix filter); as many different
words of the template as are needed must stand near (length filter), none of them ordered before that one (positional
filter). What passes is verified block by block. Beside it stand exact phrases, found at every place where their words
follow each other.

Defined cases: a null or empty text has no words, no places and score 0; a text may match many templates and each
label counts once; repeated rows are scanned each for themselves; an empty table gives an empty result; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import ascii_lower_key, materialise, whole_text

#: Everything in ASCII that is neither a digit nor a lower-case letter parts words.
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices as they stand in files and pages, by label.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "mit": [
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    ],
    "gpl-3.0": ["This work is licensed under the GNU General Public License, version 3"],
    "gpl-2.0": ["This program is licensed under the GNU General Public License, version 2"],
    "gpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"],
    "lgpl": ["Licensed under the GNU Lesser General Public License"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0", "Creative Commons Attribution ShareAlike International License"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "proprietary": ["All rights reserved. Unauthorized copying is strictly prohibited"],
}
THRESHOLD = 0.8


def words_of(text: str) -> list[str]:
    """Words of a text, of which only A-Z are lower-cased."""
    lower = text.encode("utf-8").lower().decode("utf-8")
    return [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower) if w]


def _words(text: Column) -> Column:
    """The words as keys: those of ASCII, which all templates and phrases are made of, as they are."""
    return F.filter(F.split(ascii_lower_key(text), SEPARATORS), lambda w: w != "")


def needed(tokens: int, threshold: float) -> int:
    return math.ceil(threshold * tokens - 1e-9)


def span(text: str) -> int:
    """Words of a block for a notice."""
    n = len(words_of(text))
    return n + n // 4


def _starts(words: Column, phrase: str) -> Column:
    """0-based places of a phrase in an array of words."""
    first, *rest = phrase.split()

    def here(i: Column) -> Column:
        found = F.get(words, i) == first
        for k, w in enumerate(rest, 1):
            found = found & F.coalesce(F.get(words, i + k) == w, F.lit(False))
        return found

    places = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(places, here)


def prefix_table(spark: SparkSession, templates: dict[str, list[str]], threshold: float, order: list[str]) -> DataFrame:
    """(token, label, tokens, place, n, need, span): a row for each word of each notice's prefix; tokens in the given order."""
    rank = {w: i for i, w in enumerate(order)}
    rows = []
    for label, texts in templates.items():
        for text in texts:
            tokens = sorted(set(words_of(text)), key=rank.__getitem__)
            need = needed(len(tokens), threshold)
            rows += [(t, label, tokens, i, len(tokens), need, span(text)) for i, t in enumerate(tokens[: len(tokens) - need + 1])]
    return spark.createDataFrame(rows, "token string, label string, tokens array<string>, place int, n int, need int, span int")


def match_blocks(anchors: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(row, label, containment) for every anchor and notice whose best block there meets the threshold.

    anchors: `row, at, token, near`, the place of a template word and the template words around it. The prefixes are a
    constant of the program, so joining them by broadcast is bounded.
    """
    pairs = anchors.join(F.broadcast(prefixes), "token")
    later = F.slice("tokens", F.col("place") + 1, F.col("n"))
    here = F.filter("near", lambda x: (F.abs(x["at"] - F.col("at")) < F.col("span")) & F.array_contains(F.col("later"), x["token"]))
    pairs = pairs.withColumn("later", later).where(F.size("near") >= F.col("need")).withColumn("near", here).where(F.size("near") >= F.col("need"))

    def held(x: Column) -> Column:  # different words of the notice in the block that begins with x
        inside = F.filter("near", lambda y: (y["at"] >= x["at"]) & (y["at"] < x["at"] + F.col("span")))
        return F.when(x["at"] <= F.col("at"), F.size(F.array_distinct(F.transform(inside, lambda y: y["token"])))).otherwise(0)

    best = pairs.withColumn("best", F.array_max(F.transform("near", held))).where("best >= need")
    return best.select("row", "label", (F.col("best") / F.col("n")).alias("containment"))


def scan(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """`doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score` per row of `docs`.

    score is the best containment of a reported notice, a phrase counting as contained whole.
    """
    spark = docs.sparkSession
    notices = [t for texts in templates.values() for t in texts]
    vocabulary = sorted({w for t in notices for w in words_of(t)})
    widest = max(map(span, notices))

    words = docs.select("doc_id", _words(whole_text()).alias("words"))
    spots = F.filter(F.transform("words", lambda w, i: F.when(w.isin(vocabulary), F.struct(i.alias("at"), w.alias("token")))), lambda x: x.isNotNull())
    # a phrase is looked for only where its rarest word can be
    places = [F.when(F.array_contains("words", max(p.split(), key=len)), _starts(F.col("words"), p)).otherwise(F.array().cast("array<int>")) for p in PHRASES]
    seen = words.select("doc_id", F.size("words").alias("n_words"), F.array(*places).alias("places"), spots.alias("spots"))
    seen = materialise(seen.withColumn("row", F.monotonically_increasing_id()), "license_spots")

    counted = seen.select(F.explode("spots.token").alias("token")).groupBy("token").count()
    often = {r["token"]: r["count"] for r in counted.collect()}  # as many rows as the templates have words, at most
    order = sorted(vocabulary, key=lambda w: (often.get(w, 0), w))
    prefixes = prefix_table(spark, templates, threshold, order)
    first = sorted({w for t in notices for w in sorted(set(words_of(t)), key=order.index)[: len(set(words_of(t))) - needed(len(set(words_of(t))), threshold) + 1]})

    def around(i: Column) -> Column:  # a block has no more template words than words
        start = F.greatest(i - (widest - 1), F.lit(0))
        return F.slice("spots", start + 1, i - start + widest)

    anchors = F.filter(F.transform("spots", lambda s, i: F.when(s["token"].isin(first), F.struct(s["at"].alias("at"), s["token"].alias("token"), around(i).alias("near")))), lambda x: x.isNotNull())
    anchors = seen.select("row", F.explode(anchors).alias("a")).select("row", "a.*")
    matches = match_blocks(anchors, prefixes).groupBy("row").agg(F.collect_set("label").alias("found"), F.max("containment").alias("contained"))
    all_places = F.flatten("places")
    base = F.filter(F.array(*[F.when(F.size(F.col("places")[i]) > 0, F.lit(label)) for i, label in enumerate(PHRASES.values())]), lambda x: x.isNotNull())
    out = seen.drop("spots").join(matches, "row", "left").withColumn("base", base)
    labels = F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>"))))
    return out.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.size(all_places).cast("long").alias("n_base"),
        F.array_min(all_places).cast("long").alias("first_word"), F.array_max(all_places).cast("long").alias("last_word"),
        F.array_join(F.array_sort("base"), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("contained", F.lit(0.0))).alias("score"),
    )
