"""Licence scans against a plain version; long paragraphs; near families."""

import math
import re

import pytest

from larder.llm import licenses


@pytest.fixture(scope="module")
def model(spark):
    return licenses.fit(spark)


def words(text):
    return re.findall(r"[^\W_]+(?:[.+][^\W_]+)*", text.lower())


def grams(w, sizes):
    return {" ".join(w[i : i + n]) for n in sizes for i in range(len(w) - n + 1)}


def plain(model, text):
    """(family, probability, overlap, confirmed) of a paragraph."""
    weights = {r["gram"]: r["w"] for r in model.weights.collect()}
    w = words(text)
    known = grams(w, (1, 2, 3)) & set(weights)
    z = [sum(weights[g][k] for g in known) + model.intercepts[k] for k in range(len(model.classes))]
    z = [x / model.temperature for x in z]
    p = 1 / sum(math.exp(x - max(z)) for x in z) if known else 0.0
    best = model.classes[z.index(max(z))]
    if best == licenses.UNKNOWN or p < licenses.MIN_PROBABILITY:
        return licenses.UNKNOWN, p, 0.0, False
    pairs = grams(w, (2,)) or set(w)
    overlap = max(
        len(own & pairs) / len(own) for own in (grams(words(n), (2,)) or set(words(n)) for n in licenses.TEMPLATES[best])
    )
    return best, p, overlap, overlap >= licenses.MIN_OVERLAP


def test_probability_and_overlap(spark, model):
    notices = [t for ts in licenses.TEMPLATES.values() for t in ts]
    lines = notices + list(licenses.ORDINARY) + [t for _, t in licenses.training_texts(99)][::17]
    lines += [" ".join(n.split()[::2]) + " license" for n in notices]
    # Named, but too far from every notice to be confirmed.
    lines += ["a copy under mit license", "bsd license bsd", "gpl version", "mozilla mpl 2.0 terms of the"] + ["license", "gnu gnu", "§§ copyright 日本"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "doc_id long, text string")
    rows, paragraphs = licenses.scan(spark, docs, model)
    told = {r["doc_id"]: r for r in paragraphs.collect()}
    assert len(told) == len({i for i, t in enumerate(lines) if re.search(r"(?i)\b(?:" + "|".join(licenses.ANCHORS) + r")\b", t)})
    seen = set()
    for i, r in told.items():
        family, p, overlap, confirmed = plain(model, lines[i])
        assert (r["family"], r["confirmed"]) == (family, confirmed), lines[i]
        assert abs(r["probability"] - p) < 1e-9 and abs(r["overlap"] - overlap) < 1e-12, lines[i]
        seen.add((family == licenses.UNKNOWN, confirmed))
    assert {(True, False), (False, True)} <= seen
    assert rows.count() == len(lines)


def test_a_licence_in_one_run_of_lines_of_20000_words(spark, model):
    prose = " ".join(f"word{i % 997} of the tale{i % 13}" + ("\n" if i % 9 == 0 else "") for i in range(5000))
    text = prose + "\nReleased under the MIT License.\n" + prose
    docs = spark.createDataFrame([(1, text), (2, prose.replace("\n", " ") + " Licensed under the ISC license. " + prose.replace("\n", " "))], "doc_id long, text string")
    rows, _ = licenses.scan(spark, docs, model)
    assert {r["doc_id"]: r["licences"] for r in rows.collect()} == {1: "MIT", 2: "ISC"}


def test_related_families_are_told_apart(spark, model):
    want = {
        "Licensed under the GNU Affero General Public License, version 3.": "AGPL",
        "Licensed under the GNU General Public License, version 3.": "GPL",
        "This library is licensed under the GNU Lesser General Public License, version 3.": "LGPL",
        "Released under the ISC License.": "ISC",
        "This is free and unencumbered software released into the public domain.": "Unlicense",
        "Licensed under the Eclipse Public License, version 2.0.": "EPL-2.0",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.": "ISC",
        "Licensed under the terms of a secret agreement.": "",
    }
    docs = spark.createDataFrame(list(enumerate(want)), "doc_id long, text string")
    got = {r["doc_id"]: r["licences"] for r in licenses.scan(spark, docs, model)[0].collect()}
    assert got == dict(enumerate(want.values()))
