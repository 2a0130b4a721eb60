"""Document fingerprints: a quartile bucket digest and its difference score.

Three byte triplets out of every four consecutive bytes are hashed into
``BUCKETS`` counters.  Every counter is coded by two bits, the number of
quartiles of the text's counters that it exceeds; eight steps to each doubling
code the length in bytes.  The fingerprint is hex text: two digits for the
length, then the codes of the buckets in order, four bits for two buckets.

The difference of two fingerprints is the sum of the differences of their
codes, plus ``LENGTH_WEIGHT`` for each step of length (``LENGTH_STEPS`` at
most).  Likeness is one minus the difference over its bound, cut at 0: the
bound is what two independent texts differ by on average (``FAR`` a bucket), or
the sum of the larger codes where texts are so short that this is less.
Equal texts have equal fingerprints and a likeness of 1.

``neighbour_digests`` compares every document with the next one and with a copy
of itself whose end comes from the next one.  Documents are range-partitioned
and sorted by descending id, so a text is shuffled once and neighbours meet in
a task; the last document of a partition and the first of the next one travel
through a small table (two texts a partition) and are joined there.

Results: one row per input row, repeated rows too.  A null text counts as
empty; an empty text has counters of 0 and the length code 0.  Null ids come
last in the descending order; rows of equal id are ordered by a 64-bit hash of
their text, then by the text; a single document is its own next one.  A long
text is counted piece by piece.  An empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm.common import PIECE_BYTES, extended, free_names, stored, text_bytes, text_chunks, with_fields

BUCKETS = 512
#: Mean difference of two independent codes, each of four values equally often.
FAR = 1.25
LENGTH_WEIGHT = 8
LENGTH_STEPS = 16
#: Rows counted at once.
ROWS = 512

# Places of a triplet's bytes behind its first, each with a salt of its own.
_TRIPLETS = ((1, 2, 0x00000000), (1, 3, 0x5A000000), (2, 3, 0xA5000000))
_SPREAD = np.uint32(0x9E3779B1)


def _buckets(data: np.ndarray, b: int, c: int, salt: int) -> np.ndarray:
    n = len(data) - c
    wide = data.astype(np.uint32)
    key = (wide[:n] << np.uint32(16)) | (wide[b : b + n] << np.uint32(8)) | wide[c : c + n]
    return ((key ^ np.uint32(salt)) * _SPREAD >> np.uint32(32 - 9)).astype(np.int64)


def _counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, BUCKETS) triplet counts of the texts at ``offsets``."""
    rows = len(offsets) - 1
    out = np.zeros(rows * BUCKETS, np.int64)
    if rows == 1:  # maybe long: piece by piece, each with the bytes that its last triplets need
        for at in range(0, len(data), PIECE_BYTES):
            for b, c, salt in _TRIPLETS:
                part = data[at : at + PIECE_BYTES + c]
                if len(part) > c:
                    out += np.bincount(_buckets(part, b, c, salt), minlength=BUCKETS)
        return out.reshape(1, BUCKETS)
    row = np.repeat(np.arange(rows), np.diff(offsets))
    for b, c, salt in _TRIPLETS:
        if len(data) > c:
            inside = row[:-c] == row[c:]
            out += np.bincount((row[:-c] * BUCKETS + _buckets(data, b, c, salt))[inside], minlength=len(out))
    return out.reshape(rows, BUCKETS)


def digests(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, 1 + BUCKETS): length code and bucket codes of each text."""
    rows = len(offsets) - 1
    out = np.empty((rows, 1 + BUCKETS), np.uint8)
    out[:, 0] = np.floor(8 * np.log2(np.diff(offsets) + 1.0))
    first = 0
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + PIECE_BYTES, "right")) - 1
        last = min(rows, first + ROWS, max(last, first + 1))
        counts = _counts(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        ranked = np.sort(counts, axis=1)
        codes = np.zeros(counts.shape, np.uint8)
        for part in (1, 2, 3):
            codes += counts > ranked[:, part * BUCKETS // 4 - 1, None]
        out[first:last, 1:] = codes
        first = last
    return out


def to_text(digest: np.ndarray) -> list[str]:
    """Fingerprints as hex text."""
    pairs = digest[:, 1:].reshape(len(digest), -1, 4)
    packed = (pairs[..., 0] << 6) | (pairs[..., 1] << 4) | (pairs[..., 2] << 2) | pairs[..., 3]
    raw = np.concatenate([digest[:, :1], packed], axis=1).astype(np.uint8).tobytes().hex()
    size = 2 * (1 + BUCKETS // 4)
    return [raw[i : i + size] for i in range(0, len(raw), size)]


def from_text(fingerprints: list[str]) -> np.ndarray:
    """The inverse of ``to_text``."""
    raw = np.frombuffer(bytes.fromhex("".join(fingerprints)), np.uint8).reshape(len(fingerprints), -1)
    packed = raw[:, 1:, None] >> np.array([6, 4, 2, 0], np.uint8) & 3
    return np.concatenate([raw[:, :1], packed.reshape(len(raw), -1)], axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One minus the bounded difference of the digests, row by row."""
    x, y = a[:, 1:].astype(np.int64), b[:, 1:].astype(np.int64)
    steps = np.minimum(np.abs(a[:, 0].astype(np.int64) - b[:, 0]), LENGTH_STEPS)
    difference = np.abs(x - y).sum(1) + LENGTH_WEIGHT * steps
    bound = np.minimum(FAR * BUCKETS, np.maximum(x, y).sum(1))
    return np.where(difference == 0, 1.0, 1.0 - np.minimum(difference / np.maximum(bound, 1.0), 1.0))


def fingerprint(docs: DataFrame, *, text_col: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with the fingerprint of each text; also returns the column's name."""
    (name,) = free_names(docs, "fingerprint")

    def run(batches):
        for batch in batches:
            for chunk in text_chunks(batch.column(text_col)):
                texts = to_text(digests(chunk.data, chunk.offsets))
                yield extended(batch.slice(chunk.first, chunk.rows), [name], [pa.array(texts, pa.string())])

    return docs.mapInArrow(run, with_fields(docs, [(name, T.StringType())])), name


def compare(pairs: DataFrame, a_col: str, b_col: str) -> tuple[DataFrame, str]:
    """``pairs`` with the likeness of two fingerprint columns (null where one is null)."""
    (name,) = free_names(pairs, "likeness")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                both = [part.column(c).to_pylist() for c in (a_col, b_col)]
                known = np.array([x is not None and y is not None for x, y in zip(*both, strict=True)], bool)
                score = np.zeros(len(known))
                if known.any():
                    a, b = ([x for x, ok in zip(side, known, strict=True) if ok] for side in both)
                    score[known] = likeness(from_text(a), from_text(b))
                yield extended(part, [name], [pa.array(score, pa.float64(), mask=~known)])

    return pairs.mapInArrow(run, with_fields(pairs, [(name, T.DoubleType())])), name


def _joined(a: pa.RecordBatch | None, b: pa.RecordBatch) -> pa.RecordBatch:
    if a is None or not a.num_rows:
        return b
    return pa.Table.from_batches([a, b]).combine_chunks().to_batches()[0]


_RESULTS = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def _digest_columns(texts: pa.Array) -> list[pa.Array]:
    """The columns ``_RESULTS`` of every text but the last, each with the one behind it."""
    data, offsets = text_bytes(texts)
    starts = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # of code points
    first = np.searchsorted(starts[:-1], offsets)
    n = np.diff(first)
    lost = n[:-1] // 3
    cut = starts[first[1:-1] - lost]
    taken = starts[first[1:-1] + np.minimum(lost, n[1:])]
    raw = data.tobytes()
    spans = zip(offsets[:-2].tolist(), cut.tolist(), offsets[1:-1].tolist(), taken.tolist(), strict=True)
    edited = [raw[a:b] + raw[c:d] for a, b, c, d in spans]
    own = digests(data, offsets)
    other = digests(
        np.frombuffer(b"".join(edited), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in edited]))).astype(np.int64)
    )
    return [
        pa.array(n[:-1].astype(np.int64)),
        pa.array([hashlib.sha256(x).hexdigest() for x in edited], pa.string()),
        pa.array(to_text(own[:-1]), pa.string()),
        pa.array(to_text(other), pa.string()),
        pa.array(likeness(own[:-1], other)),
        pa.array(likeness(own[:-1], own[1:])),
    ]


def neighbour_digests(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) per row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("hash")]
    # The row's number lets rows that are alike in id and text fall into several partitions.
    ranged = rows.repartitionByRange(*order, F.monotonically_increasing_id()).sortWithinPartitions(*order, "text").select("doc_id", "text")

    id_type = rows.schema["doc_id"].dataType.simpleString()
    kinds = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def walk(batches: Iterator[pa.RecordBatch]):
        place = TaskContext.get().partitionId()
        names = ["edge", "place", "doc_id", "text", *_RESULTS]

        def edge(kind: str, row: pa.RecordBatch) -> pa.RecordBatch:
            nothing = [pa.nulls(1, t) for t in (pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64())]
            return pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([place], pa.int32()), *row.columns, *nothing], names=names)

        held = None
        for batch in batches:
            for chunk in text_chunks(batch.column(1)):
                part = batch.slice(chunk.first, chunk.rows)
                if held is None:
                    yield edge("first", part.slice(0, 1))
                part = _joined(held, part)
                held = part.slice(part.num_rows - 1)
                m = part.num_rows - 1
                if m:
                    yield pa.RecordBatch.from_arrays(
                        [pa.nulls(m, pa.string()), pa.array(np.full(m, place, np.int32)), part.column(0).slice(0, m), pa.nulls(m, pa.string()),
                         *_digest_columns(part.column(1))],
                        names=names,
                    )
        if held is not None:
            yield edge("last", held)

    told = stored(spark, ranged.mapInArrow(walk, f"edge string, place int, doc_id {id_type}, text string, {kinds}"), "neighbours")
    inner = told.where("edge is null").select("doc_id", *_RESULTS)

    # Across partitions: a row with a text for the start and the end of each.
    starts = told.where("edge = 'first'").select("place", F.col("text").alias("next"))
    places = sorted(r["place"] for r in starts.select("place").collect())
    if not places:
        return inner
    steps = spark.createDataFrame(list(zip(places, places[1:] + places[:1], strict=True)), "place int, after int")
    pairs = told.where("edge = 'last'").select("place", "doc_id", "text").join(steps, "place")
    pairs = pairs.join(starts.withColumnRenamed("place", "after"), "after").select("doc_id", "text", "next")

    def across(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for i in range(batch.num_rows):
                texts = pa.concat_arrays([batch.column(1).slice(i, 1), batch.column(2).slice(i, 1)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), *_digest_columns(texts)], names=["doc_id", *_RESULTS])

    return inner.unionByName(pairs.mapInArrow(across, f"doc_id {id_type}, {kinds}"))
