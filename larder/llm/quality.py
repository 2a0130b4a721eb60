"""Quality classifier: supervised subword embeddings.

A document is the bag of its features: every word, every byte n-gram of a word
(3 and 4 bytes, a neighbouring space standing for the word's edge) and a
marker for a word that repeats the one before it, all hashed into ``buckets``
places.  Each place has a learned vector; the vectors of all features of a
document are averaged, a softmax layer turns the mean into class
probabilities.  Vectors and layer are trained by numpy stochastic gradient
descent with a linearly falling rate.  The layer's bias holds the odds of the
labels: training uses those of its sample, scoring those of all labelled rows.

Training is fitted to a bounded sample: about ``per_class`` labelled rows of
each class (ids are drawn by a hash, repeated texts count once); features of a sampled text are counted over the whole text on the
executors.  Scoring reads every whole text.  Because the mean is linear, the
scoring tasks hold the product of vectors and layer (``buckets`` x classes).

Results: ``score`` is the probability of label 1, ``predicted`` 1 if it is at
least ``threshold``.  Null, empty and blank texts have no features and get the
score of the layer's bias alone.  Equal texts get equal scores.  Without
labelled rows of both classes the score is the share of label 1 (0.5 without
any).  Other columns pass through untouched whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm.common import (
    NOT_SPACE, Chunk, held_out, extended, free_names, text_chunks, tidy, with_fields, words_of,
)

BUCKETS = 1 << 16
DIM = 12
#: Training steps (documents shown): every sampled row at least this often.
EPOCHS = 5
STEPS = 12_000
RATE = 0.5
PER_CLASS = 2000
THRESHOLD = 0.3
GRAMS = (3, 4)

_G3 = np.uint32(0x9E3779B1)
_G4 = np.uint32(0x85EBCA77)


def features(chunk: Chunk, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of every feature occurrence of a chunk."""
    data, offsets = chunk.data, chunk.offsets
    n = len(data)
    mask = np.uint32(buckets - 1)
    if n == 0:
        return np.zeros(0, np.int32), np.zeros(0, np.uint32)
    words = words_of(chunk, NOT_SPACE)
    rows, places = [words.row], [(words.hash >> np.uint64(40)).astype(np.uint32) & mask]
    again = np.zeros(len(words.hash), bool)
    if len(again):
        again[1:] = (words.hash[1:] == words.hash[:-1]) & (words.row[1:] == words.row[:-1])
    places[0][again] = 0  # the repeat marker takes the word's place
    # Byte n-grams whose inner bytes are no white space, within one row.
    row_of = np.repeat(np.arange(chunk.rows, dtype=np.int32), np.diff(offsets))
    inner = NOT_SPACE[data]
    code = np.where(inner, data, 32).astype(np.uint32)
    pair = code[:-1] << np.uint32(8) | code[1:]
    if n >= 3:
        ok = inner[1:-1] & (row_of[:-2] == row_of[2:])
        gram = (pair[:-1] << np.uint32(8) | code[2:]) * _G3
        rows.append(row_of[:-2][ok])
        places.append(gram[ok] >> np.uint32(16) & mask)
    if n >= 4:
        ok = inner[1:-2] & inner[2:-1] & (row_of[:-3] == row_of[3:])
        gram = (pair[:-2] << np.uint32(16) | pair[2:]) * _G4
        rows.append(row_of[:-3][ok])
        places.append(gram[ok] >> np.uint32(16) & mask)
    return np.concatenate(rows), np.concatenate(places)


@dataclass
class Model:
    """(buckets, classes) products of vectors and layer, and the layer's bias."""

    table: np.ndarray
    bias: np.ndarray

    def scores(self, chunk: Chunk) -> np.ndarray:
        """Probability of class 1 per row of the chunk."""
        row, place = features(chunk, len(self.table))
        lift = (self.table[:, 1] - self.table[:, 0])[place]
        count = np.maximum(np.bincount(row, minlength=chunk.rows), 1)
        logit = np.bincount(row, lift, chunk.rows) / count + (self.bias[1] - self.bias[0])
        return 1.0 / (1.0 + np.exp(-np.clip(logit, -500, 500)))


def train(bags, labels: np.ndarray, *, buckets: int, dim: int, epochs: int, rate: float, seed: int = 7) -> Model:
    """SGD over ``bags`` [(places, counts)] with 0/1 labels, one document at a time."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1.0 / dim, 1.0 / dim, (buckets, dim)).astype(np.float32)
    layer = rng.normal(0, 0.1, (dim, 2)).astype(np.float32)
    share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    bias = np.log(np.array([1 - share, share])).astype(np.float32)
    done, total = 0, epochs * len(bags)
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            places, counts = bags[i]
            step = rate * (1 - done / total)
            done += 1
            if not len(places):
                continue
            part = (counts / counts.sum()).astype(np.float32)
            mean = part @ vectors[places]
            logit = mean @ layer + bias
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[labels[i]] -= 1.0
            back = layer @ p
            layer -= step * np.outer(mean, p)
            # Each feature's vector moves by its share; scaled up as in any
            # averaged-embedding model so that rare features learn.
            vectors[places] -= step * 20.0 * part[:, None] * back
    return Model((vectors @ layer).astype(np.float32), bias)


def sample_bags(texts: DataFrame, marks: DataFrame, *, per_class: int, buckets: int):
    """(bags, labels, count of each label in ``marks``) of the bounded sample.

    ``marks`` (k, label 0/1) is thinned to about ``per_class`` ids of each
    label; these few ids, at most twice as many as asked for, go to the texts
    (id, text), so that no text is shuffled but the sampled ones.
    """
    counts = {r["label"]: r["count"] for r in marks.groupBy("label").count().collect()}
    draw = F.pmod(F.xxhash64("k"), F.lit(1 << 30)) / float(1 << 30)
    rate = F.lit(1.0)
    for label, n in counts.items():
        rate = F.when(F.col("label") == label, F.lit(min(1.0, per_class / n))).otherwise(rate)
    most = 2 * per_class * max(1, len(counts))
    drawn = marks.where(draw < rate).limit(most)
    picked = texts.join(F.broadcast(drawn), F.col("id") == F.col("k")).dropDuplicates(["text", "label"]).limit(most)

    def count(batches):
        for batch in batches:
            for chunk in text_chunks(batch.column(0)):
                row, place = features(chunk, buckets)
                key, times = np.unique(row.astype(np.int64) * buckets + place, return_counts=True)
                cuts = pa.array(np.searchsorted(key, np.arange(chunk.rows + 1) * buckets).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(1).slice(chunk.first, chunk.rows),
                        pa.ListArray.from_arrays(cuts, pa.array((key % buckets).astype(np.int32))),
                        pa.ListArray.from_arrays(cuts, pa.array(times.astype(np.float32))),
                    ],
                    names=["label", "places", "counts"],
                )

    found = picked.select("text", "label").mapInArrow(tidy(count), "label int, places array<int>, counts array<float>").toArrow()
    bags = []
    for piece in found.to_batches():
        p, c = piece.column("places"), piece.column("counts")
        po, pv, cv = np.asarray(p.offsets), np.asarray(p.values), np.asarray(c.values)
        bags += [(pv[a:b], cv[a:b]) for a, b in zip(po[:-1], po[1:], strict=True)]
    labels = np.concatenate([np.asarray(x) for x in found.column("label").chunks]) if len(bags) else np.zeros(0, int)
    # The order of rows must not depend on the partitioning.
    order = sorted(range(len(bags)), key=lambda i: (labels[i], bags[i][0].tobytes(), bags[i][1].tobytes()))
    return [bags[i] for i in order], labels[order].astype(int), counts


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    per_class: int = PER_CLASS,
    buckets: int = BUCKETS,
    dim: int = DIM,
    epochs: int = EPOCHS,
    rate: float = RATE,
) -> Model:
    """Model from the labelled rows that are not held out (crc32 of the id mod 5 is not 0)."""
    marks = labels.select(F.col(id_col).alias("k"), F.col(label_col).cast("int").alias("label"))
    marks = marks.where(F.col("label").isin(0, 1) & ~held_out("k", 5)).dropDuplicates()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    bags, y, counts = sample_bags(texts, marks, per_class=per_class, buckets=buckets)
    if len(set(y.tolist())) < 2:
        share = np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6)
        return Model(np.zeros((buckets, 2), np.float32), np.log(np.array([1 - share, share])))
    epochs = max(epochs, -(-STEPS // len(bags)))  # small samples are shown more often
    model = train(bags, y, buckets=buckets, dim=dim, epochs=epochs, rate=rate)
    # Each label is thinned apart: the odds of the sample give way to those of all labelled rows.
    share = np.array([counts[0], counts[1]], float) / (counts[0] + counts[1])
    return Model(model.table, np.log(share).astype(np.float32))


def score(
    spark: SparkSession, docs: DataFrame, model: Model, *, text_col: str = "text", threshold: float = THRESHOLD
) -> tuple[DataFrame, str, str]:
    """``docs`` with (score, predicted) at its end; also returns their names."""
    sent = spark.sparkContext.broadcast((model.table, model.bias))  # buckets x 2 floats
    names = free_names(docs, "score", "predicted")
    schema = with_fields(docs, list(zip(names, (T.DoubleType(), T.IntegerType()), strict=True)))

    def judge(batches):
        held = Model(*sent.value)
        for batch in batches:
            parts = [held.scores(c) for c in text_chunks(batch.column(text_col))]
            s = np.concatenate(parts) if parts else np.zeros(0)
            yield extended(batch, names, [pa.array(s), pa.array((s >= threshold).astype(np.int32))])

    return docs.mapInArrow(tidy(judge), schema), *names


def quality_scores(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns for every document."""
    scored, s, p = score(spark, docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", held_out("doc_id", 5).alias("held_out"), F.col(s), F.col(p))
