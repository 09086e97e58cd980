"""Licence scans: a trained, sparse classifier of paragraphs over word n-grams, with a calibrated unknown class and template confirmation.

Training is small: templates of each family with variations, and as the unknown class a bounded sample of paragraphs
that name no licence, sentences about licences that grant none, and templates broken so that they name none. L1
regularisation leaves few n-grams with a weight. The confidence is calibrated on templates that training never saw.
Scoring is a join of a paragraph's n-grams with the weights. A paragraph without any word of a weighted n-gram has the
score of an empty one, and the calibration keeps that score below the least confidence, so such paragraphs are passed
over without being scored. A prediction is confirmed if the paragraph holds most of a template of the family, all its
numbers, and more of it than of any other family's templates.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arachne.llm import shared as S

# Names of licences and sentences that grant them, by family.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache-2.0": ("Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.', "SPDX-License-Identifier: Apache-2.0", "This project is available under the Apache License 2.0."),
    "mit": ("The MIT License", "Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "SPDX-License-Identifier: MIT", "This project is licensed under the MIT License."),
    "isc": ("The ISC License", "Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "SPDX-License-Identifier: ISC", "This project is licensed under the ISC License."),
    "gpl-2.0": ("GNU General Public License, version 2", "This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License", "SPDX-License-Identifier: GPL-2.0-only", "Licensed under the GNU GPL version 2."),
    "gpl-3.0": ("GNU General Public License, version 3", "This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", "SPDX-License-Identifier: GPL-3.0-only", "Licensed under the GNU GPL version 3."),
    "lgpl-2.1": ("GNU Lesser General Public License, version 2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License", "SPDX-License-Identifier: LGPL-2.1-only", "Licensed under the GNU LGPL version 2.1."),
    "lgpl-3.0": ("GNU Lesser General Public License, version 3", "This library is licensed under the GNU Lesser General Public License, version 3.", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License", "SPDX-License-Identifier: LGPL-3.0-only", "Licensed under the GNU LGPL version 3."),
    "agpl-3.0": ("GNU Affero General Public License, version 3", "This work is licensed under the GNU Affero General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License", "SPDX-License-Identifier: AGPL-3.0-only", "Licensed under the GNU AGPL version 3."),
    "cc0-1.0": ("CC0 1.0 Universal", "Licensed under CC0 1.0.", "This work is dedicated to the public domain under the Creative Commons CC0 1.0 Universal Public Domain Dedication.", "SPDX-License-Identifier: CC0-1.0"),
    "cc-by-4.0": ("CC BY 4.0", "Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0", "Shared under CC BY 4.0 with attribution."),
    "cc-by-sa-4.0": ("CC BY-SA 4.0", "Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0", "Shared under CC BY-SA 4.0 for sharing alike."),
    "cc-by-nc-4.0": ("CC BY-NC 4.0", "Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0", "Shared under CC BY-NC 4.0 for noncommercial use."),
    "bsd-2-clause": ("BSD 2-Clause License", "Released under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause", "This project is licensed under the simplified BSD 2-Clause License."),
    "bsd-3-clause": ("BSD 3-Clause License", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause", "This project is licensed under the BSD 3-Clause License."),
    "mpl-2.0": ("Mozilla Public License, version 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "unlicense": ("This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense", "Released into the public domain under the Unlicense."),
    "all-rights-reserved": ("All rights reserved.", "Copyright. All rights reserved. No part of this publication may be reproduced without permission."),
}
#: Sentences with the words of licences that grant nothing.
NOT_LICENCES = (
    "A driving licence is needed to hire a car.", "The software licence costs ten euros a month.", "Permission is required to enter the building.", "The copyright office opens at nine.",
    "Version 3 of the program was released in May.", "Version 2.0 of the map is out.", "All rights of the citizens are protected by law.", "The public domain of the town has three parks.",
    "Mozilla published a new browser.", "The Apache web server handles requests.", "MIT is a university in Massachusetts.", "GNU tools are used by many people.", "A licensed electrician must check the wiring.",
    "Redistribution of income was discussed.", "Creative work is common in the commons room.", "The foundation is free of charge for members.", "Source files and binary files are kept apart.", "Table 4.0 shows the attribution of costs.",
    "The general public was warned.", "Files under this folder are generated.", "Read the license before you sign the contract.", "Which license should I choose for my project?", "He lost his fishing license.", "Reserved seats are marked.",
)
#: Words from which a template counts as long.
LONG = 10
#: Openings and endings that vary the templates for training.
OPENINGS = ("", "The text is", "Note:", "Copyright 2024 the authors.", "This page is")
ENDINGS = ("", "See the file for details.", "Some terms apply.")
#: Paragraphs of the corpus that the unknown class is fitted on, at most; and n-grams of the vocabulary.
UNKNOWN_SAMPLE = 2000
VOCABULARY = 8192
#: Words of a template's n-grams for confirmation, and the share of a template's n-grams that a paragraph must hold.
CONFIRM_GRAM = 2
CONFIRM_SHARE = 0.7
SCALES = (0.5, 1.0, 2.0, 4.0, 8.0)
#: Confidences that are tried as the least one of a known class.
LEAST = (0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99)
#: Precision that the calibrated threshold of the known classes aims at on held-out paragraphs.
PRECISION = 0.98

# Words too common to make a paragraph worth scoring alone.
COMMON = frozenset("the a an of and or to in is are be by with for under this that it as at on from no not any all you may use see some".split())

_WORDS = r"filter(split(lower({t}), '[^\\p{{L}}\\p{{N}}.+]+'), w -> rtrim('.', w) <> '')"


def _tokens(text: str) -> str:
    return f"transform({_WORDS.format(t=text)}, w -> rtrim('.', w))"


def _grams(words: str) -> str:
    """SQL: the distinct 1- to 3-grams of a word array."""
    def of(n: int) -> str:
        return f"if(size({words}) >= {n}, transform(sequence(0, size({words}) - {n}), i -> array_join(slice({words}, i + 1, {n}), ' ')), cast(array() as array<string>))"

    return f"array_distinct(concat({of(1)}, {of(2)}, {of(3)}))"


def _training() -> list[tuple[str, str, bool]]:
    """(family, text, held out). Of a family with four templates or more the last is held out whole; so are every third
    sentence that grants nothing and every third broken template, a long one that keeps every third word."""
    rows = []
    for family, texts in TEMPLATES.items():
        for i, t in enumerate(texts):
            held = len(texts) > 3 and i == len(texts) - 1
            rows += [(family, f"{a} {t} {e}".strip(), held) for a in OPENINGS for e in ENDINGS]
            if len(t.split()) >= LONG:
                rows.append(("unknown", " ".join(t.split()[1::3]), i % 3 == 2))
    return rows + [("unknown", f"{t} {e}".strip(), i % 3 == 2) for i, t in enumerate(NOT_LICENCES) for e in ENDINGS]


def paragraphs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (doc_id, paragraph, text): the lines of each text, counted from 0."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.posexplode(F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "\n")).alias("paragraph", "text"))


class Model:
    """Weights of the classifier: rows (gram, weights by class), intercepts, the scale of the scores and the least confidence."""

    def __init__(self, labels: list[str], weights: dict[str, list[float]], intercepts: list[float]):
        self.labels, self.weights, self.intercepts = labels, weights, intercepts
        self.scale, self.least = 1.0, 0.5
        self.held: list[tuple[int, float, int]] = []  # class, confidence and predicted class of each held-out paragraph

    def anchors(self) -> list[str]:
        return sorted({w for g in self.weights for w in g.split(" ") if w not in COMMON})

    def probabilities(self, grams) -> list[float]:
        z = list(self.intercepts)
        for g in set(grams):
            for k, w in enumerate(self.weights.get(g, ())):
                z[k] += w
        top = max(z)
        e = [math.exp((x - top) * self.scale) for x in z]
        return [x / sum(e) for x in e]


def train(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fits on the templates' variations and the unknown class; calibrates the scale and the least confidence on what was held out.

    The corpus gives the unknown class at most UNKNOWN_SAMPLE paragraphs, whole, of documents chosen by a hash of their
    text; of them half is held out, by a hash of theirs. The weights are then fitted again on all.
    """
    known = spark.createDataFrame(_training(), "family string, text string, held boolean")
    naming = "text rlike '(?i)licen[sc]e|copyright|rights reserved|spdx|permission is|redistribut|creative commons|public license|public domain'"
    every = max(1, docs.count() // UNKNOWN_SAMPLE)
    some = docs.where(F.pmod(F.xxhash64(F.col(text_col)), F.lit(every)) == 0)
    other = paragraphs(some, id_col, text_col).where(f"length(text) > 0 and not ({naming})").select("text").orderBy(F.xxhash64("text"), "text").limit(UNKNOWN_SAMPLE)
    rows = known.union(other.select(F.lit("unknown"), "text", F.pmod(F.xxhash64("text"), F.lit(2)) == 0))
    rows = rows.withColumn("words", F.expr(_tokens("text"))).select("family", "words", F.expr(_grams("words")).alias("grams"), "held")
    labels = ["unknown", *sorted(TEMPLATES)]
    rows = rows.withColumn("label", F.array_position(F.array(*map(F.lit, labels)), F.col("family")).cast("double") - 1)
    # The vocabulary holds what templates say; words that only strangers use can't name a licence.
    words = F.array(*map(F.lit, sorted(COMMON)))
    grams = F.filter("grams", lambda g: F.size(F.array_except(F.split(g, " "), words)) > 0)
    rows = S.saved(rows.withColumn("grams", grams), "licence-training")
    vector = CountVectorizer(inputCol="grams", outputCol="features", binary=True, vocabSize=VOCABULARY).fit(rows.where("family <> 'unknown'"))

    def fitted(part: DataFrame) -> Model:
        fit = LogisticRegression(family="multinomial", elasticNetParam=1.0, regParam=0.002, maxIter=60).fit(vector.transform(part).select("label", "features"))
        table = fit.coefficientMatrix.toArray()
        weights = {g: table[:, k].tolist() for k, g in enumerate(vector.vocabulary) if abs(table[:, k]).max() > 1e-6}
        return Model(labels[: len(table)], weights, fit.interceptVector.toArray().tolist())

    model = fitted(rows.where("not held"))
    held = [(int(r.label), r.grams) for r in rows.where("held").select("label", "grams").toLocalIterator() if r.label < len(model.labels)]
    if held:
        def loss(scale: float) -> float:
            model.scale = scale
            return -sum(math.log(max(model.probabilities(g)[y], 1e-12)) for y, g in held) / len(held)

        model.scale = min(SCALES, key=lambda s: (loss(s), s))
        best = [(max(p), p.index(max(p)), y) for y, p in ((y, model.probabilities(g)) for y, g in held)]
        for model.least in LEAST:
            taken = [k == y for p, k, y in best if k and p >= model.least]
            if sum(taken) >= PRECISION * len(taken):
                break
        whole = fitted(rows)  # on all, now that the scale and the least confidence are set on what that fit had not seen
        whole.scale, whole.least, whole.held = model.scale, model.least, [(y, p, k) for p, k, y in best]
        model = whole
    # What is passed over unscored has the intercepts' score, which must give no row.
    model.least = max(model.least, max(model.probabilities(())[1:], default=0.0) + 1e-6)
    return model


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, paragraph, family, confidence, template_share, confirmed), one for each paragraph with a licence.

    A paragraph is a line. family is the most probable class if its calibrated confidence reaches the model's least;
    paragraphs of the unknown class give no row. template_share is the largest share of the word pairs of a template of
    the family that the paragraph holds with all the template's numbers; confirmed, that it is at least CONFIRM_SHARE
    and above the share of every other family's templates. Cases: null or empty texts have no licence; a document may
    hold several; very long texts are scanned whole, line by line; rows that repeat are scanned each; null ids stay null;
    ties of classes go to the first family in order, ties of shares aren't confirmed; an empty table gives an empty
    result; other columns are ignored.
    """
    spark = docs.sparkSession
    anchors = ", ".join("'" + w.replace("\\", "").replace("'", "\\'") + "'" for w in model.anchors()) or "''"
    lines = paragraphs(docs, id_col, text_col).withColumn("words", F.expr(_tokens("text"))).where(f"exists(words, w -> w in ({anchors}))").select("doc_id", "paragraph", "words")
    lines = S.saved(lines.withColumn("row", F.monotonically_increasing_id()), "licence-lines")
    weights = spark.createDataFrame(list(model.weights.items()) or [("", [0.0] * len(model.labels))], "gram string, w array<double>")  # at most VOCABULARY rows
    sums = [F.sum(F.col("w")[k]).alias(f"z{k}") for k in range(len(model.labels))]
    scored = lines.select("row", F.explode(F.expr(_grams("words"))).alias("gram")).join(F.broadcast(weights), "gram").groupBy("row").agg(*sums)
    z = [(F.col(f"z{k}") + model.intercepts[k]) * model.scale for k in range(len(model.labels))]
    best = F.array_max(F.array(*[F.struct(v.alias("z"), F.lit(-k).alias("k")) for k, v in enumerate(z)]))
    scored = scored.select("row", best.alias("best"), F.array(*z).alias("z"))
    scored = scored.select("row", F.element_at(F.array(*map(F.lit, model.labels)), 1 - F.col("best.k")).alias("family"), F.expr("1 / aggregate(z, 0D, (a, x) -> a + exp(x - best.z))").alias("confidence"))
    named = lines.join(scored.where((F.col("family") != "unknown") & (F.col("confidence") >= model.least)), "row")
    pairs = lambda w: f"if(size({w}) >= {CONFIRM_GRAM}, array_distinct(transform(sequence(0, size({w}) - {CONFIRM_GRAM}), i -> array_join(slice({w}, i + 1, {CONFIRM_GRAM}), ' '))), {w})"
    number = "w -> w rlike '[0-9]'"
    texts = spark.createDataFrame([(f, t) for f, many in TEMPLATES.items() for t in many], "family string, template string").withColumn("tw", F.expr(_tokens("template")))
    every = F.collect_list(F.struct("family", F.expr(pairs("tw")).alias("pairs"), F.expr(f"filter(tw, {number})").alias("numbers"))).alias("templates")
    out = named.join(F.broadcast(texts.agg(every))).withColumn("own", F.expr(pairs("words")))  # one row: the fixed table
    out = out.withColumn("shares", F.expr("transform(templates, t -> struct(t.family as family, if(size(array_except(t.numbers, words)) = 0, round(size(array_intersect(t.pairs, own)) / size(t.pairs), 4), 0D) as share))"))
    out = out.withColumn("template_share", F.expr("array_max(transform(filter(shares, s -> s.family = family), s -> s.share))")).withColumn("rival", F.expr("array_max(transform(filter(shares, s -> s.family <> family), s -> s.share))"))
    return out.select("doc_id", "paragraph", "family", F.round("confidence", 4).alias("confidence"), "template_share", ((F.col("template_share") >= CONFIRM_SHARE) & (F.col("template_share") > F.col("rival"))).alias("confirmed"))


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return scan(docs, train(docs.sparkSession, docs, id_col, text_col), id_col, text_col)
