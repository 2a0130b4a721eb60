"""Licence scans: a trained paragraph classifier, native Spark only.

A paragraph is a line, and also a run of several lines without a blank one
between them (a line without letters and digits counts as blank), read as one
line, so that wrapped notices are found whole.  Paragraphs without any licence
word (``ANCHORS``) are not licence paragraphs by definition; the others are
judged by a multinomial logistic regression over binary word uni-, bi- and trigrams.  The model is
fitted by Spark ML on the reference notices of ``TEMPLATES`` and on
derived variants, against an ``unknown`` class made of ordinary sentences with
licence words and of shuffled notices.  A temperature, chosen on variants kept
out of training, calibrates the probabilities; a family needs at least
``min_probability``.  A prediction counts only if template comparison confirms
it: enough of the word bigrams of one of the family's notices must occur in
the paragraph.

The main path is DataFrame code alone: split, filter, explode the word n-grams
of the few licence lines, join them with the model's weights (a table whose
size is fixed by the templates), sum, compare.  The text itself is never
shuffled.

Results: one row per input row.  ``licences`` lists the confirmed families,
sorted and comma-joined (empty if none); ``n_confirmed`` and ``n_unconfirmed``
count paragraphs (lines and runs of lines) whose prediction was confirmed or not; ``probability`` is the
highest of the confirmed ones (0.0 if none).  Null and empty texts and texts
without licence words have no licences.  Repeated rows are judged one by one,
null ids are kept; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.common import stored

MIN_PROBABILITY = 0.5
MIN_OVERLAP = 0.6
UNKNOWN = "unknown"

# Words of which a licence paragraph holds at least one.
ANCHORS = (
    "licen[cs]e[sd]?", "licensing", "licensee", "licensor", "copyright", "copyleft", "spdx", "gnu", "gpl", "lgpl", "agpl",
    "apache", "bsd", "mozilla", "mpl", "creative commons", "cc by", "cc0", "redistributions?", "redistribute[ds]?",
    "warranty", "warranties", "sublicense", "unlicense", "public domain",
    "hereby granted",
)
# What every one of them holds: found first, by plain search in the lower-cased text.
ROOTS = (
    "licen", "copyright", "copyleft", "spdx", "gnu", "gpl", "apache", "bsd", "mozilla", "mpl", "creative commons", "cc by",
    "cc0", "redistribut", "warrant", "public domain", "hereby granted",
)

# Short notices by which works name their licence family.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "This project is released under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "AGPL": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
        "Licensed under the AGPL version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "BSD": (
        "Released under the BSD 3-Clause License.",
        "Licensed under the BSD license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ),
    "CC0": (
        "Released under CC0 1.0.",
        "To the extent possible under law, the author has dedicated this work to the public domain under CC0.",
        "SPDX-License-Identifier: CC0-1.0",
    ),
    "EPL-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
        "Licensed under the Eclipse Public License, version 2.0.",
        "SPDX-License-Identifier: EPL-2.0",
    ),
    "GPL": (
        "Licensed under the GNU General Public License, version 3.",
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "Licensed under the GPL version 2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "ISC": (
        "Released under the ISC License.",
        "Licensed under the ISC license.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
    ),
    "LGPL": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "Licensed under the LGPL version 3.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "SPDX-License-Identifier: MIT",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "Unlicense": (
        "Released under the Unlicense.",
        "This is free and unencumbered software released into the public domain.",
        "SPDX-License-Identifier: Unlicense",
    ),
}

# Sentences with licence words that name no licence (own examples).
ORDINARY = (
    "Please renew your driving license before the end of the year.",
    "The fishing licence costs twelve pounds and is sold at the harbour.",
    "Copyright 2019 by the author. All rights reserved.",
    "The warranty of this kettle covers two years of ordinary use.",
    "She studied physics at MIT and later moved to Geneva.",
    "The Apache helicopter landed near the village at noon.",
    "A gnu is a large antelope of the African plains.",
    "The company licensed its patents to a rival for a yearly fee.",
    "He lost his pilot license after the accident.",
    "Send the report to the office, cc the director.",
    "The licensee shall pay the licensor within thirty days.",
    "Mozilla publishes a web browser and a mail client.",
    "The public domain status of the old map is unclear.",
    "No license is granted by this agreement.",
    "The redistribution of income was the subject of the debate.",
    "Without warranty of any kind the shop sold used cars.",
    "This version of the work was printed under a general agreement.",
    "The free software meeting takes place in the public library.",
)


def words_of(text: Column) -> Column:
    """Lower-cased words: runs of letters, digits, dots and plus signs inside a word."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+(?:[.+][\p{L}\p{N}]+)*)"), F.lit(1))


def windows(words: Column, n: int) -> Column:
    """All runs of ``n`` words, space-joined."""
    runs = F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(F.size(words) >= n, runs).otherwise(F.array().cast("array<string>"))


def ngrams_of(words: Column, longest: int = 3) -> Column:
    """Distinct word n-grams of 1 to ``longest`` words."""
    return F.array_distinct(F.concat(*[windows(words, n) for n in range(1, longest + 1)]))


def bigrams_of(words: Column) -> Column:
    return F.array_distinct(F.when(F.size(words) > 1, windows(words, 2)).otherwise(words))


def of_words(text: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of the words of ``text``; they are found once, whatever ``body`` does with them."""
    return F.get(F.transform(F.array(words_of(text)), lambda words: body(words)), F.lit(0))


def training_texts(seed: int = 11) -> list[tuple[str, str]]:
    """(family, text): notices, variants with words lost or added, and the unknown class."""
    rng = random.Random(seed)
    filler = [w for s in ORDINARY for w in s.rstrip(".").split()]
    rows: list[tuple[str, str]] = []
    for family, notices in TEMPLATES.items():
        for notice in notices:
            words = notice.split()
            rows += [(family, notice)] * 6
            for _ in range(16):  # a long paragraph around it, a word lost
                kept = [w for w in words if rng.random() > 0.06]
                around = rng.sample(filler, rng.randint(0, 8))
                cut = rng.randint(0, len(around))
                rows.append((family, " ".join(around[:cut] + kept + around[cut:])))
            for _ in range(6):  # most of the notice replaced: names no licence
                rows.append((UNKNOWN, " ".join(w if rng.random() < 0.3 else rng.choice(filler) for w in words)))
            for _ in range(3):  # its words without their order, family names left out
                mixed = [w for w in words if w.lower().strip(".,:") in ("the", "license", "licensed", "under", "this", "work", "is", "version")]
                rng.shuffle(mixed)
                rows.append((UNKNOWN, " ".join(mixed + rng.sample(filler, 4))))
    for sentence in ORDINARY:
        rows += [(UNKNOWN, sentence)] * 3
        words = sentence.split()
        rows += [(UNKNOWN, " ".join(w for w in words if rng.random() > 0.2)) for _ in range(6)]
    return rows


@dataclass
class Model:
    """``weights`` (gram, w array per class), intercepts, class names, temperature."""

    weights: DataFrame
    intercepts: list[float]
    classes: list[str]
    temperature: float


@lru_cache(maxsize=8)
def _learned(regularisation: float, iterations: int) -> tuple[list[tuple[str, list[float]]], list[float], list[str], float]:
    """What ``fit`` learns: the same numbers for the same arguments."""
    spark = SparkSession.active()
    classes = [*sorted(TEMPLATES), UNKNOWN]
    rows = [(i, classes.index(c), t) for i, (c, t) in enumerate(training_texts())]
    data = spark.createDataFrame(rows, "i int, label int, text string").coalesce(1)
    data = data.select("i", F.col("label").cast("double").alias("label"), of_words(F.col("text"), ngrams_of).alias("grams")).cache()
    kept_out = F.col("i") % 5 == 0
    count = CountVectorizer(inputCol="grams", outputCol="features", binary=True).fit(data.where(~kept_out))
    learner = LogisticRegression(maxIter=iterations, regParam=regularisation, family="multinomial", standardization=False)
    model = learner.fit(count.transform(data.where(~kept_out)).select("label", "features"))
    told = model.transform(count.transform(data.where(kept_out))).select("label", "rawPrediction").collect()
    data.unpersist()
    logits = [(int(r["label"]), r["rawPrediction"].toArray()) for r in told]
    import numpy as np

    def loss(t: float) -> float:
        total = 0.0
        for label, z in logits:
            z = z / t
            total += np.log(np.exp(z - z.max()).sum()) + z.max() - z[label]
        return total

    temperature = min((0.25 * 2 ** (n / 4) for n in range(0, 21)), key=loss)
    matrix = model.coefficientMatrix.toArray()
    table = [(gram, [float(x) for x in matrix[:, j]]) for j, gram in enumerate(count.vocabulary)]
    return table, [float(x) for x in model.interceptVector], classes, float(temperature)


def fit(spark: SparkSession, *, regularisation: float = 0.0005, iterations: int = 80) -> Model:
    """Train and calibrate; the material is ``TEMPLATES`` and ``ORDINARY``, a few hundred rows."""
    table, intercepts, classes, temperature = _learned(regularisation, iterations)
    return Model(spark.createDataFrame(table, "gram string, w array<double>"), intercepts, classes, temperature)


def scan(
    spark: SparkSession,
    docs: DataFrame,
    model: Model,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_probability: float = MIN_PROBABILITY,
    min_overlap: float = MIN_OVERLAP,
) -> tuple[DataFrame, DataFrame]:
    """(one row per input row, one row per licence paragraph).

    Rows: (doc_id, licences, n_confirmed, n_unconfirmed, probability).
    Paragraphs: (doc_id, paragraph, text, family, probability, overlap, confirmed).
    """
    anchors = r"(?i)\b(?:" + "|".join(ANCHORS) + r")\b"
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.lower(text_col).alias("low"))
    hinted = F.lit(False)
    for root in ROOTS:
        hinted = hinted | F.contains(F.col("low"), F.lit(root))
    runs = F.filter(F.split(F.col("text"), r"\n(?:[^\p{L}\p{N}\n]*\n)+"), lambda p: F.trim(p, F.lit("\r\n")).contains("\n"))
    paragraphs = F.concat(F.split(F.col("text"), "\n"), F.transform(runs, lambda p: F.translate(p, "\r\n", "  ")))
    lines = F.when(hinted, F.filter(paragraphs, lambda p: p.rlike(anchors)))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", lines.alias("lines"))
    # Written once: rows with their licence paragraphs, or with none.
    found = stored(spark, rows.select("row", "doc_id", F.posexplode_outer("lines").alias("paragraph", "text")), "licence_paragraphs")

    # Sum the weights of each paragraph's n-grams, class by class; the texts stay behind.
    k = len(model.classes)
    at = ["row", "paragraph"]
    grams = found.where("paragraph is not null").select(*at, F.explode(of_words(F.col("text"), ngrams_of)).alias("gram"))
    sums = (
        grams.join(F.broadcast(model.weights), "gram")  # fixed by the templates
        .groupBy(*at)
        .agg(*[F.sum(F.col("w")[i]).alias(f"z{i}") for i in range(k)])
    )
    logits = F.array(*[(F.col(f"z{i}") + model.intercepts[i]) / model.temperature for i in range(k)])
    judged = sums.select(*at, logits.alias("z")).withColumn("top", F.array_max("z"))
    judged = judged.select(
        *at,
        F.element_at(F.array(*[F.lit(c) for c in model.classes]), F.array_position("z", F.col("top")).cast("int")).alias("best"),
        (1 / F.aggregate("z", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))).alias("probability"),
    )
    # A paragraph without any n-gram of the model names no licence.
    judged = found.join(judged, at, "left").withColumn("probability", F.coalesce("probability", F.lit(0.0)))
    sure_enough = (F.col("best") != UNKNOWN) & (F.col("probability") >= min_probability)
    family = F.when(sure_enough, F.col("best")).otherwise(UNKNOWN)
    judged = judged.withColumn("family", F.when(F.col("paragraph").isNotNull(), family))

    # Compare with each notice of the predicted family.
    notices = spark.createDataFrame([(f, t) for f, ts in TEMPLATES.items() for t in ts], "family string, notice string")
    notices = notices.groupBy("family").agg(F.collect_list(of_words(F.col("notice"), bigrams_of)).alias("notices"))
    own = F.when(F.col("family") != UNKNOWN, of_words(F.col("text"), bigrams_of))

    def overlap_of(own: Column) -> Column:
        return F.array_max(F.transform("notices", lambda n: F.size(F.array_intersect(n, own)) / F.size(n)))

    overlap = F.get(F.transform(F.array(own), overlap_of), F.lit(0))
    compared = judged.join(F.broadcast(notices), "family", "left").select(
        "row", "doc_id", "paragraph", "text", "family", "probability", F.coalesce(overlap, F.lit(0.0)).alias("overlap")
    )
    compared = compared.withColumn("confirmed", (F.col("family") != UNKNOWN) & (F.col("overlap") >= min_overlap))
    sure = F.coalesce(F.col("confirmed"), F.lit(False))
    per_row = compared.groupBy("row", "doc_id").agg(
        F.array_join(F.array_sort(F.collect_set(F.when(sure, F.col("family")))), ",").alias("licences"),
        F.count_if(sure).alias("n_confirmed"),
        F.count_if((F.col("family") != UNKNOWN) & ~sure).alias("n_unconfirmed"),
        F.coalesce(F.max(F.when(sure, F.col("probability"))), F.lit(0.0)).alias("probability"),
    )
    return per_row.drop("row"), compared.where("paragraph is not null").drop("row")


def licence_scan(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The registered query: one row per document."""
    return scan(spark, docs, fit(spark))[0]
