"""License notices in slide texts by diagonal voting.

All windows of a few words of all texts are hashed and joined with the windows of license
templates. Hits of one template vote for the offset between text and template; hits on one
diagonal, and on neighbouring ones, make a span, which must cover enough of the template and
hold little else. All of it is column expressions and joins; no rows leave the JVM.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deckloom.llm.common import stored

#: Words of a window, and by how much diagonals of one span may be apart.
WINDOW, SLACK = 3, 4
#: Least part of the template's words that a span covers, and of the span's words that the template covers.
COVERAGE, DENSITY = 0.6, 0.6
#: Phrases and the labels they give by themselves (fixed values of the contract).
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Labels and texts of license notices (fixed values: wording of the licenses).
TEMPLATES = (
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance "
               "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is "
               "distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
            "Public License as published by the Free Software Foundation"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the Software), to deal in the Software without restriction"),
    ("mit", "Released under the MIT License."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)
_GAPS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def template_words(text: str) -> list[str]:
    return [w for w in re.split(_GAPS, text.lower()) if w]


def _words(text: Column) -> Column:
    # Small letters of other alphabets do not matter: phrases and templates are plain A to Z.
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), _GAPS), "")


def _triples(words: Column) -> Column:
    return F.arrays_zip(words.alias("w1"), *[
        F.slice(words, i, F.greatest(F.size(words), F.lit(1))).alias(f"w{i}") for i in range(2, WINDOW + 1)])


def template_windows(spark: SparkSession) -> DataFrame:
    """``gram, template, at`` and the words of every window of every template; some hundred rows."""
    rows = [(t, i, *words[i:i + WINDOW]) for t, (_, text) in enumerate(TEMPLATES)
            for words in [template_words(text)] for i in range(len(words) - WINDOW + 1)]
    names = [f"t{i}" for i in range(1, WINDOW + 1)]
    found = spark.createDataFrame(rows, "template int, at int, " + ", ".join(f"{n} string" for n in names))
    return found.withColumn("gram", F.xxhash64(*names))


def window_hits(slides: DataFrame) -> DataFrame:
    """``slide_key, template, at, pos``: windows of texts that are windows of templates, word for word."""
    names = [f"w{i}" for i in range(1, WINDOW + 1)]
    rows = slides.select("slide_key", F.posexplode(_triples(_words(F.col("text")))).alias("pos", "w")).select(
        "slide_key", "pos", *[F.col("w")[n].alias(n) for n in names])
    hashed = rows.where(F.col(names[-1]).isNotNull()).withColumn("gram", F.xxhash64(*names))
    same = [F.col(n) == F.col(f"t{n[1:]}") for n in names]
    hits = hashed.join(F.broadcast(template_windows(slides.sparkSession)), "gram")
    for check in same:
        hits = hits.where(check)
    return hits.select("slide_key", "template", "at", "pos")


def _spans(hits: DataFrame, by: str) -> DataFrame:
    """Verified spans of the hits that share ``by``: how much of the template each covers."""
    covered = hits.select("slide_key", "template", by, "pos", F.explode(
        F.sequence(F.col("at"), F.col("at") + WINDOW - 1)).alias("word"))
    sizes = F.array(*[F.lit(len(template_words(text))) for _, text in TEMPLATES])
    spans = covered.groupBy("slide_key", "template", by).agg(
        F.count_distinct("word").alias("n"), F.min("pos").alias("first"), (F.max("pos") + WINDOW).alias("end"))
    spans = spans.withColumn("coverage", F.col("n") / sizes[F.col("template")])
    return spans.where((F.col("coverage") >= COVERAGE) & (F.col("n") >= DENSITY * (F.col("end") - F.col("first")))).select(
        "slide_key", "template", "coverage")


def license_spans(slides: DataFrame) -> DataFrame:
    """``slide_key, template, coverage`` of verified spans in ``slides`` (``slide_key, text``)."""
    # Read three times below: the texts are gone through once.
    hits = stored(window_hits(slides), "license-hits").withColumn("diagonal", F.col("pos") - F.col("at"))
    votes = hits.groupBy("slide_key", "template", "diagonal").agg(F.count(F.lit(1)).alias("votes"))
    order = Window.partitionBy("slide_key", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > SLACK, F.lit(True)).cast("int")
    joined = votes.withColumn("_apart", apart).withColumn("band", F.sum("_apart").over(order)).select(
        "slide_key", "template", "diagonal", "band")
    # A repeated notice has neighbouring diagonals that make one long span: each diagonal also stands for itself.
    return _spans(hits, "diagonal").union(_spans(hits.join(joined, ["slide_key", "template", "diagonal"]), "band"))


def _base(words: Column) -> list[Column]:
    """Places of the phrases: count, first and last word, labels."""
    line = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    count = lambda part: F.size(F.array_remove(F.split(part, " "), ""))
    found, first, last, labels = [], [], [], []
    for phrase, label in PHRASES:
        inside, spaced = F.contains(line, F.lit(f" {phrase} ")), f" {phrase} "
        found.append(F.when(inside, F.regexp_count(line, F.lit(f" {phrase}(?= )"))).otherwise(F.lit(0)))
        first.append(F.when(inside, count(F.substring_index(line, spaced, 1))))
        last.append(F.when(inside, F.size(words) - count(F.substring_index(line, spaced, -1)) - len(phrase.split())))
        labels.append(F.when(inside, F.lit(label)))
    total = found[0]
    for n in found[1:]:
        total = total + n
    return [total.cast("bigint").alias("n_base"), F.least(*first).cast("bigint").alias("first_word"),
            F.greatest(*last).cast("bigint").alias("last_word"), F.array_compact(F.array(*labels)).alias("base")]


def license_scan(slides: DataFrame) -> DataFrame:
    """License mentions of each slide row (``slide_id, text``; more columns are left aside).

    Returns ``slide_id, n_words, n_base, first_word, last_word, base_labels, labels, score``: the base columns count the
    phrases; ``labels`` adds those of the templates found; ``score`` is 1 with a base label, else the largest
    part of a template that a verified span covers, else 0. Null texts are empty ones: no words, no labels. Rows that
    agree in id and text get the same result, each its own row; an empty table gives an empty result.
    """
    # Rows are told apart by id and text, with nulls marked, so that joins find them.
    keyed = slides.select("slide_id", "text", F.struct(
        F.col("slide_id").isNull().alias("n"), F.coalesce("slide_id", F.lit(0)).alias("i"), F.xxhash64("text").alias("t")).alias("slide_key"))
    names = F.array(*[F.lit(label) for label, _ in TEMPLATES])
    spans = license_spans(keyed).groupBy("slide_key").agg(
        F.collect_set(names[F.col("template")]).alias("more"), F.max("coverage").alias("coverage"))
    words = keyed.select("slide_id", "slide_key", _words(F.col("text")).alias("words"))
    rows = words.select("slide_id", "slide_key", F.size("words").cast("bigint").alias("n_words"), *_base(F.col("words")))
    joined = rows.join(spans, "slide_key", "left")
    line = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    every = F.concat("base", F.coalesce("more", F.array().cast("array<string>")))
    return joined.select("slide_id", "n_words", "n_base", "first_word", "last_word", line(F.col("base")).alias("base_labels"),
                         line(every).alias("labels"), F.when(F.size("base") > 0, F.lit(1.0)).otherwise(
                             F.coalesce("coverage", F.lit(0.0))).alias("score"))
