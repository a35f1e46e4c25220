"""Operator 2: licence paragraphs by a trained classifier (DataFrame only).

Paragraphs are the lines of a text, and its wrapped sentences: a sentence that runs over
several lines is judged as a whole too (:func:`wrapped`), and counts where none of its
lines counts alone.  Their features are word 1- and 2-grams.  A
multinomial logistic regression over the licence families and the class
``unknown`` is trained on the templates below (each whole and with single words
left out) against decoy sentences and at most ``NEGATIVES`` lines of the corpus
(chosen by a hash).  A prediction counts if its probability exceeds that of 99 %
of the unknown training lines (and one half), and if the line shares at least
``CONFIRM`` of its n-grams, or of the template's, with a template of that family.

Only lines with two different words of templates that may reach ``CONFIRM`` are classified
(:func:`evidence`); any other line with two such words would fail that check.  Which
lines these are follows from the templates alone, never from the corpus.  Each distinct
line is classified once, so a line that a third of all documents share costs one row
after the map-side aggregation.

Defined cases: a null or blank text yields no row; repeated rows yield
repeated result rows; a null doc_id is kept; an empty table gives an empty
result; other columns are ignored; a character U+0001 is read as a space.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm.common import cut

NEGATIVES = 2000
CONFIRM = 0.6
# Of a line's different words at least this share is known where CONFIRM of its n-grams are.
KNOWN = 0.4
ODDS = 0.5
UNKNOWN = "unknown"

# Usual wordings of licence notices by family.
TEMPLATES = {
    "agpl": ["This program is free software under the GNU Affero General Public License, version 3.",
             "Licensed under the GNU Affero General Public License.", "SPDX-License-Identifier: AGPL-3.0-only"],
    "apache": ["Licensed under the Apache License, Version 2.0.",
               "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
               "compliance with the License.",
               "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
               "SPDX-License-Identifier: Apache-2.0"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met",
            "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
            "Released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "cc0": ["This work is dedicated to the public domain under CC0 1.0 Universal.",
            "To the extent possible under law, the author has waived all copyright and related rights to this work.",
            "This work is released into the public domain."],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 "
              "International License.", "Available under the Creative Commons Attribution license."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons "
                 "Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC-SA 4.0."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons "
                 "Attribution-ShareAlike 4.0 International License.",
                 "Text is available under the Creative Commons Attribution-ShareAlike License."],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.",
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
            "Public License as published by the Free Software Foundation.",
            "Licensed under the GNU GPL, version 2 or later.", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "lgpl": ["Licensed under the GNU Lesser General Public License, version 2.1.",
             "This library is free software under the terms of the GNU Lesser General Public License.",
             "SPDX-License-Identifier: LGPL-2.1-or-later"],
    "mit": ["Released under the MIT License.", "Licensed under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files, to deal in the Software without restriction",
            "SPDX-License-Identifier: MIT"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
            "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "proprietary": ["All rights reserved.", "Copyright (c) the authors. All rights reserved.",
                    "No part of this publication may be reproduced without prior written permission of the publisher.",
                    "This document is confidential and proprietary."],
}
# Sentences with words of licences that license nothing.
DECOYS = [
    "She renewed her driving license at the public office in version of the old form.",
    "The general opinion of the public was free of any doubt.", "He reserved all the tables for the guests.",
    "A new version of the library was released under pressure.", "The source of the river lies in the north.",
    "The use of the file was governed by habit.", "They were granted permission to deal with the matter in person.",
    "The common attribution of the painting is wrong.", "Work is work and terms are terms.",
    "The foundation published a copy of the international report.", "All rights and no duties, he said.",
    "You may obtain a copy of the menu at the door.",
]


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def grams(words: Column) -> Column:
    """Distinct word 1- and 2-grams."""
    def of(w: Column) -> Column:
        two = F.when(F.size(w) > 1, F.transform(F.sequence(F.lit(1), F.size(w) - 1),
                                                lambda i: F.concat_ws(" ", F.get(w, i - 1), F.get(w, i))))
        return F.array_distinct(F.concat(w, F.coalesce(two, F.array().cast("array<string>"))))

    # The array of one element evaluates the words once, not once for each of them.
    return F.get(F.transform(F.array(words), of), 0)


def _gram_set(words: list[str]) -> set[tuple[str, ...]]:
    return {(w,) for w in words} | set(zip(words, words[1:], strict=False))


def _cues(sets: list[set[tuple[str, ...]]]) -> list[str]:
    """Words, long ones first, such that CONFIRM of a template's n-grams cannot be
    had without one of them."""
    out = set()
    for grams_of in sets:
        need = math.ceil(CONFIRM * len(grams_of) - 1e-9)
        for w in sorted({w for g in grams_of for w in g}, key=lambda w: (-len(w), w)):
            if sum(out.isdisjoint(g) for g in grams_of) < need:
                break
            out.add(w)
    return sorted(out)


def evidence(line: Column) -> Column:
    """Whether a line has two different words of templates and may reach CONFIRM.

    It shares that part of a template's n-grams only with one of the template's cues, and
    has that part of its own in a template only with ``KNOWN`` of its different words: a
    foreign word is missing itself and in half a 2-gram at least, and shared words form
    at most 2.375 shared 2-grams each (no template has more than 5 repeated steps).
    """
    sets = [_gram_set([w for w in re.split("[^a-z0-9]+", t.lower()) if w]) for ts in TEMPLATES.values() for t in ts]
    known, cues = sorted({w for s in sets for g in s for w in g}), _cues(sets)
    most = int(max(map(len, sets)) / CONFIRM + 1) // 2  # n different words have 2n - 1 n-grams or more

    def enough(words: Column) -> Column:
        own = F.size(F.filter(words, lambda w: w.isin(known)))
        short = (F.size(words) <= most) & (own >= KNOWN * F.size(words))
        return (own >= 2) & (F.exists(words, lambda w: w.isin(cues)) | short)

    # The array of one element evaluates the words once.
    return F.exists(F.array(F.array_distinct(tokens(line))), enough)


# Where a wrapped sentence may end: behind a mark before a capital, behind a mark at a line's end, around blank lines.
# Lines are written as number, U+0001, text.
SENTENCE_EDGE = "(?<=[.!?][ \\t])(?=\\p{Lu})|(?<=[.!?]\\n)|(?<=\\n)(?=[0-9]{1,10}\\x01(?:\\n|\\z))|(?<=\\x01\\n)"


def wrapped(text: Column) -> Column:
    """The sentences of a text that lie on several lines: array of (paragraph: number
    of the first line, n_lines, line: the words, line breaks kept)."""
    lines = F.split(F.translate(text, "\x01", " "), "\n")
    marked = F.array_join(F.transform(lines, lambda x, i: F.concat(i.cast("string"), F.lit("\x01"), F.rtrim(x, F.lit(" \t\r")))), "\n")

    def entry(piece: Column) -> Column:
        words = F.rtrim(F.regexp_replace(piece, "(?<![^\\n])[0-9]+\\x01", ""), F.lit("\n"))
        first = F.regexp_extract(piece, "([0-9]+)\\x01", 1).cast("int")
        return F.struct((first - F.when(piece.rlike("\\A[0-9]+\\x01"), 0).otherwise(1)).alias("paragraph"),
                        F.size(F.split(words, "\n")).alias("n_lines"), words.alias("line"))

    return F.transform(F.filter(F.split(marked, SENTENCE_EDGE), lambda p: p.rlike("\\n[0-9]+\\x01.")), entry)


def _table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small DataFrame from literals, without Python workers."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("r")) \
        .select("r.*")


def _training(lines: DataFrame) -> DataFrame:
    """label, words: templates with and without single words; unknown lines."""
    spark = lines.sparkSession
    known = _table(spark, [{"label": k, "line": t} for k, ts in TEMPLATES.items() for t in ts]
                   + [{"label": UNKNOWN, "line": t} for t in DECOYS], "label:string, line:string")
    words = known.select("label", tokens(F.col("line")).alias("w"))
    short = words.select("label", F.explode(F.sequence(F.lit(-1), F.size("w") - 1)).alias("k"), "w").select(
        "label", F.filter("w", lambda x, i: i != F.col("k")).alias("words"))
    # Lines of the corpus stand for unknown, unless they share a 2-gram with a template.
    own = [r["g"] for r in words.where(F.col("label") != UNKNOWN).select(F.explode(grams(F.col("w"))).alias("g"))
           .where("g like '% %'").distinct().collect()]
    other = (lines.orderBy(F.xxhash64("doc_id", "line"), "line").limit(NEGATIVES)
             .select(tokens(F.col("line")).alias("words"))
             .where(~F.arrays_overlap(grams(F.col("words")), F.array(*map(F.lit, sorted(own)))))
             .select(F.lit(UNKNOWN).alias("label"), "words", F.lit(True).alias("corpus")))
    rows = short.withColumn("corpus", F.lit(False)).unionByName(other)
    return cut(rows.where(F.size("words") > 0).withColumn("g", grams(F.col("words"))))


class Classifier:
    """Weights per n-gram and class, as literals for DataFrame expressions."""

    def __init__(self, lines: DataFrame):
        from pyspark.ml.classification import LogisticRegression
        from pyspark.ml.feature import CountVectorizerModel
        spark = lines.sparkSession
        train = _training(lines)
        self.classes = [*sorted(TEMPLATES), UNKNOWN]
        number = F.array_position(F.array(*map(F.lit, self.classes)), F.col("label")) - 1
        rows = train.withColumn("y", number.cast("double"))
        # The vocabulary: n-grams of the templates and decoys, not of the corpus lines.
        seen = (train.where("not corpus").select(F.explode("g").alias("g")).distinct().orderBy("g"))
        vocab = [r["g"] for r in seen.collect()]
        bag = CountVectorizerModel.from_vocabulary(vocab, "g", "features")
        model = LogisticRegression(featuresCol="features", labelCol="y", family="multinomial", regParam=1e-3,
                                   maxIter=60, standardization=False).fit(bag.transform(rows))
        coef, self.bias = model.coefficientMatrix.toArray(), [float(x) for x in model.interceptVector.toArray()]
        self.weights = [{"gram": g, "w": [float(x) for x in coef[:, i]]} for i, g in enumerate(vocab)]
        self.table = _table(spark, self.weights, "gram:string, w:array<double>")
        self.level = ODDS
        unknown = self.probabilities(train.where(F.col("label") == UNKNOWN).select(F.concat_ws(" ", "words").alias("line")).distinct())
        top = unknown.agg(F.percentile_approx("p", 0.99, 10_000)).first()[0]
        self.level = max(ODDS, float(top or 0.0))

    def probabilities(self, lines: DataFrame) -> DataFrame:
        """distinct lines -> line, family (the likeliest), p."""
        part = (lines.select("line", F.explode(grams(tokens(F.col("line")))).alias("gram"))
                .join(F.broadcast(self.table), "gram"))  # one row per vocabulary entry, fixed by TEMPLATES
        n = len(self.classes)
        logit = part.groupBy("line").agg(*[F.sum(F.col("w")[i]).alias(f"z{i}") for i in range(n)])
        z = [F.col(f"z{i}") + F.lit(self.bias[i]) for i in range(n)]
        top = F.greatest(*z[:-1])
        total = sum((F.exp(x - F.greatest(*z)) for x in z), F.lit(0.0))
        family = F.coalesce(*[F.when(x == top, F.lit(c)) for x, c in zip(z[:-1], self.classes[:-1], strict=True)])
        return logit.select("line", family.alias("family"), (F.exp(top - F.greatest(*z)) / total).alias("p"))


def _similarity(spark: SparkSession, found: DataFrame) -> DataFrame:
    """line, family, p, similarity: best containment in a template of the family."""
    temp = _table(spark, [{"family": k, "t": t} for k, ts in TEMPLATES.items() for t in ts], "family:string, t:string")
    temp = temp.select("family", grams(tokens(F.col("t"))).alias("tg"))
    own = grams(tokens(F.col("line")))
    shared = F.size(F.array_intersect("g", "tg"))
    return (found.withColumn("g", own).join(F.broadcast(temp), "family")
            .withColumn("s", F.greatest(shared / F.size("g"), shared / F.size("tg")))
            .groupBy("line", "family", "p").agg(F.max("s").alias("similarity")))


def license_paragraphs(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) -> one row per licence paragraph: doc_id,
    paragraph (number of its first line from 0), family, probability, similarity, n_lines."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    every = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.trim("line") != "")
    model = Classifier(every)
    lines = (docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), F.posexplode(F.split("text", "\n")).alias("paragraph", "line"))
             .withColumn("n_lines", F.lit(1)))
    runs = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), F.inline(wrapped(F.col("text"))))
    lines = cut(lines.unionByName(runs).where(evidence(F.col("line"))))
    likely = model.probabilities(lines.groupBy("line").agg(F.count("*").alias("n"))).where(F.col("p") > model.level)
    verdict = cut(_similarity(docs.sparkSession, likely).where(F.col("similarity") >= CONFIRM))
    found = cut(lines.join(verdict, "line").drop("line"))
    alone, runs = found.where("n_lines = 1"), found.where("n_lines > 1")
    told = (runs.select("row", "paragraph", F.explode(F.expr("sequence(paragraph, paragraph + n_lines - 1)")).alias("at"))
            .join(alone.select("row", F.col("paragraph").alias("at")), ["row", "at"], "left_semi").select("row", "paragraph"))
    return (alone.unionByName(runs.join(told, ["row", "paragraph"], "left_anti"))
            .select("doc_id", "paragraph", "family", F.round("p", 6).alias("probability"),
                    F.round("similarity", 6).alias("similarity"), "n_lines"))
