"""Quartile bucket digests: against a plain version, edits, odd input."""

import hashlib
import random

from pyspark.sql import functions as F

from conftest import SF_SMALL
from llm_fixtures import no_docs, odd_docs  # noqa: F401
from larder.llm import fingerprints
from larder.llm.common import table


def plain_digest(text):
    data, counts = text.encode(), [0] * 512
    for b, c, salt in ((1, 2, 0), (1, 3, 0x5A000000), (2, 3, 0xA5000000)):
        for i in range(len(data) - c):
            key = (data[i] << 16 | data[i + b] << 8 | data[i + c]) ^ salt
            counts[(key * 0x9E3779B1 & 0xFFFFFFFF) >> 23] += 1
    ranked = sorted(counts)
    codes = [sum(n > ranked[k] for k in (127, 255, 383)) for n in counts]
    size = 0
    while 2 ** ((size + 1) / 8) <= len(data) + 1:
        size += 1
    return size, codes


def plain_text(digest):
    size, codes = digest
    return f"{size:02x}" + "".join(f"{codes[i] << 2 | codes[i + 1]:x}" for i in range(0, 512, 2))


def plain_likeness(a, b):
    diff = sum(abs(x - y) for x, y in zip(a[1], b[1], strict=True)) + 8 * min(16, abs(a[0] - b[0]))
    bound = min(640, sum(max(x, y) for x, y in zip(a[1], b[1], strict=True)))
    return 1.0 if diff == 0 else 1 - min(1, diff / max(1, bound))


def expected(rows):
    """The rows, in the order of descending ids (unique here), with their digests."""
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = {}
    for i, (doc_id, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        k = len(text) // 3
        edited = text[: len(text) - k] + after[:k]
        own, other, third = plain_digest(text), plain_digest(edited), plain_digest(after)
        out[doc_id] = (
            len(text), hashlib.sha256(edited.encode()).hexdigest(), plain_text(own), plain_text(other),
            plain_likeness(own, other), plain_likeness(own, third),
        )
    return out


def found(frame):
    return [(r["doc_id"], tuple(r)[1:]) for r in frame.collect()]


def same(a, b):
    return a[:4] == b[:4] and all(abs(x - y) < 1e-12 for x, y in zip(a[4:], b[4:], strict=True))


def test_neighbours_against_a_plain_version(spark):
    rng = random.Random(4)
    rows = [(i * 7 % 61, "".join(rng.choice("abcdé 日\n") for _ in range(rng.randint(0, 90)))) for i in range(61)]
    rows += [(100, None), (101, ""), (102, "x"), (103, "日本語 text"), (None, "the row without an id"), (-5, "below zero " * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.lit("clash")).repartition(5)
    want, got = expected(rows), found(fingerprints.neighbour_digests(spark, docs))
    assert len(got) == len(rows)
    assert all(same(want[doc_id], row) for doc_id, row in got)
    # The same whatever the partitions, also with one row a partition.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        assert sorted(map(str, found(fingerprints.neighbour_digests(spark, docs)))) == sorted(map(str, got))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_registered_query_against_a_plain_version(spark):
    docs = table(spark, SF_SMALL, "documents").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    want = expected(rows)
    got = found(fingerprints.neighbour_digests(spark, docs))
    assert len(got) == len(rows) and all(same(want[i], row) for i, row in got)
    # An edited third stays nearer than an unrelated neighbour.
    assert sum(row[4] > row[5] for _, row in got) >= 0.98 * sum(row[2] != row[3] for _, row in got)


def test_repeats_ties_long_and_empty_tables(spark, odd_docs, no_docs):  # noqa: F811
    got = found(fingerprints.neighbour_digests(spark, odd_docs))
    assert len(got) == odd_docs.count()
    by_id = {}
    for doc_id, row in got:
        by_id.setdefault(doc_id, []).append(row)
    assert by_id[7][0][2] == by_id[8][0][2] and len(by_id[2]) == 2 and len(by_id[None]) == 2
    assert by_id[11][0][0] > 600_000
    assert fingerprints.neighbour_digests(spark, no_docs).count() == 0
    one = found(fingerprints.neighbour_digests(spark, odd_docs.where("doc_id = 7")))
    assert one[0][1][5] == 1.0 and one[0][1][1] == hashlib.sha256(b"short tsho").hexdigest()


def test_fingerprint_and_compare_keep_the_other_columns(spark, odd_docs, no_docs):  # noqa: F811
    marked, name = fingerprints.fingerprint(odd_docs.withColumn("Fingerprint", F.lit(1)))
    assert name == "_fingerprint" and marked.columns[:-1] == [*odd_docs.columns, "Fingerprint"]
    pairs = marked.select("doc_id", F.col(name).alias("a")).withColumn("likeness", F.lit("x"))
    pairs = pairs.withColumn("b", F.when(F.col("doc_id") != 7, F.col("a")))
    told, score = fingerprints.compare(pairs, "a", "b")
    for r in told.collect():
        assert r[score] == (None if r["b"] is None else 1.0)
    assert fingerprints.fingerprint(no_docs)[0].count() == 0
    # A long text, counted piece by piece, has the digest of the whole.
    long = "".join(chr(97 + (i * i) % 23) for i in range(2_500_000))
    row = fingerprints.fingerprint(spark.createDataFrame([(long,)], "text string"))[0].collect()[0]
    assert row["fingerprint"] == plain_text(plain_digest(long))
