"""Language-model scoring of documents.

Texts are lower-cased (A-Z) words separated by ASCII white space, and one end
after the last word.  Two scores are given:

* ``base_score``: a word unigram with add-one smoothing, exact counts of every
  training document;
* ``score``: the log10 probability of the whole text under a causal
  self-attention model (``attention``) over the subword ids of a public
  SentencePiece vocabulary.  A text's ids fall into overlapping windows; every
  id is scored once, the first ids of a later window are context only, and
  windows are scored in batches with a causal mask.  A word's probability is
  half that of its ids (and of a word starting after them, given that one
  starts with them, which makes it a distribution over words) and half that of
  the unigram of ``base_score``.

Corpus statistics cover all training documents and come from Spark
aggregations: word counts, from them the counts of subword ids (each distinct
word is cut into subwords once), from these the classes of the model's output
and the probabilities inside them.

The model is trained on every window of every training document, on the
executors.  Document clusters (they form the classes) start from about
``fit_rows`` documents and are moved by k-means rounds over all of them.
Attention weights start in one task on a share of the documents drawn by hash
(about ``SEED_IDS`` ids; small tables lie in it whole and are shown several
times); the other documents are dealt over ``ROUNDS`` rounds.  In a round every
partition trains on from the same weights, and what the partitions changed is
averaged, by the windows behind it.  The averages depend a little on how the
table is cut into partitions; which windows are learned from does not.

Scoring holds a bounded table of frequent words (at most ``frequent``; every
word that could be a hot key is in it).  The rest of a document's words go
through a join with the counts, each word once a document with the
probabilities that its occurrences have by their ids: there their unigram half,
taken as that of an unseen word before, gets the true count.  ``frequent``
decides where a count is looked up, not whether.

Results: a null or empty text is the end alone.  ``held_out`` rows (crc32 of
the id mod 7 is 2) are not learned from; a null id is never held out.  Words
are counted by their text; scoring finds them by a 64-bit hash.  Equal texts
get equal scores.  With no training rows N and V are 0.  An empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

from dataclasses import fields
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import attention
from larder.llm.common import CHUNK_BYTES, NOT_SPACE, Chunk, Words, held_out, span_texts, stored, text_chunks, words_of
from larder.llm.sentencepiece_codec import MODEL_PATH

BOS, END = 1, 2
FREQUENT = 300_000
FIT_ROWS = 1000
SEED_IDS = 1_000_000
ROUNDS = 4
CLUSTER_ROUNDS = 3
#: Ids whose counts tell clusters of documents apart.
TOP_IDS = 3000
#: Windows shuffled at once while training.
BUFFER = 4096
BATCH = 256
#: Windows scored at once; more would not stay in a core's cache.
SCORED = 128


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) over all rows; words are counted per chunk before the shuffle."""

    def count(batches):
        for batch in batches:
            for chunk in text_chunks(batch.column(0), 8 << 20):
                words = words_of(chunk, NOT_SPACE)
                _, first, n = np.unique(words.hash, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [span_texts(chunk.data, words.start[first], words.end[first]), pa.array(n.astype(np.int64))], names=["word", "n"]
                )

    parts = docs.select(text_col).mapInArrow(count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


class Ids:
    """Subword ids of words, found by hash: a fixed table and the words met since.

    The fixed table's hashes ascend; words are looked for from the first hash that
    begins with the same bits on.  ``starts`` and ``sizes`` say where the ids of the
    words of both tables (the fixed one's first) stand in ``pool``.
    """

    LIMIT = 1_000_000

    def __init__(self, model: bytes, hashes=None, offsets=None, ids=None):
        import sentencepiece

        self.encoder = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.hashes = np.zeros(0, np.uint64) if hashes is None else hashes
        self.base = (np.zeros(1, np.int64) if offsets is None else offsets, np.zeros(0, np.int32) if ids is None else ids)
        self.bits = max(1, len(self.hashes).bit_length() + 1)
        firsts = np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)
        self.first = np.append(np.searchsorted(self.hashes, firsts), len(self.hashes)).astype(np.int32)
        self.clear()

    def clear(self) -> None:
        """Forget the words met since."""
        self.met, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.starts, self.sizes, self.pool = self.base[0][:-1], np.diff(self.base[0]), self.base[1]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of words as they stand after a space."""
        if not len(texts):
            return np.zeros(1, np.int64), np.zeros(0, np.int32)
        # No word has a line's end in it: one string is cut faster than many are made.
        words = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts), "\n")[0].as_py().split("\n")
        found = self.encoder.encode(words, num_threads=1)
        size = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.int32, int(size.sum()))
        return np.concatenate(([0], np.cumsum(size))), flat

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the fixed table, whether the word is there) of each hash."""
        if not len(self.hashes):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        slot = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        at, stop = self.first[slot].astype(np.int64), self.first[slot + 1]
        hit = self.hashes[np.minimum(at, len(self.hashes) - 1)] == keys
        open_ = np.flatnonzero(~hit & (at + 1 < stop))
        while len(open_):
            at[open_] += 1
            same = self.hashes[at[open_]] == keys[open_]
            hit[open_[same]] = True
            open_ = open_[~same & (at[open_] + 1 < stop[open_])]
        return np.where(hit, at, 0), hit

    def learn(self, hashes: np.ndarray, words: pa.Array) -> None:
        """Take up words that neither table has."""
        offsets, ids = self.encode(words)
        every = np.concatenate([self.met, hashes])
        order = np.argsort(every, kind="stable")
        self.met = every[order]
        self.number = np.concatenate([self.number, len(self.starts) + np.arange(len(hashes))])[order]
        self.starts = np.concatenate([self.starts, len(self.pool) + offsets[:-1]])
        self.sizes = np.concatenate([self.sizes, np.diff(offsets)])
        self.pool = np.concatenate([self.pool, ids])

    def met_since(self, chunk: Chunk, words: Words, which: np.ndarray) -> np.ndarray:
        """Numbers of the chosen words, none of them in the fixed table; new ones are taken up."""
        keys, first, back = np.unique(words.hash[which], return_index=True, return_inverse=True)
        if len(self.met) > self.LIMIT:
            self.clear()
        at = np.minimum(np.searchsorted(self.met, keys), max(0, len(self.met) - 1))
        new = np.flatnonzero(self.met[at] != keys) if len(self.met) else np.arange(len(keys))
        if len(new):
            one = which[first[new]]
            self.learn(keys[new], span_texts(chunk.data, words.start[one], words.end[one]))
            at = np.searchsorted(self.met, keys)
        return self.number[at][back]

    def runs(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray, Words]:
        """(ids of all rows, each with its end; ids per row; the words with their ids' number and place in the fixed table)."""
        words = words_of(chunk, NOT_SPACE)
        at, hit = self.find(words.hash)
        words.place = np.where(hit, at, -1)
        other = np.flatnonzero(~hit)
        if len(other):
            at[other] = self.met_since(chunk, words, other)
        size = self.sizes[at]
        stop = np.cumsum(size)
        pool = self.pool[np.repeat(self.starts[at] - (stop - size), size) + np.arange(int(stop[-1]) if len(stop) else 0)]
        per_row = np.bincount(words.row, size, chunk.rows).astype(np.int64) + 1
        flat = np.full(int(per_row.sum()), END, np.int32)
        inside = np.ones(len(flat), bool)
        inside[np.cumsum(per_row) - 1] = False
        flat[inside] = pool
        words.tokens = size
        return flat, per_row, words


def batches(flat: np.ndarray, per_row: np.ndarray, window: int, overlap: int, size: int = BATCH, apart: bool = False):
    """(inputs, targets, mask, row, place in ``flat``) of the windows of all rows, ``size`` windows at a time.

    ``apart``: the first windows of all rows come before all others.
    """
    starts = np.cumsum(per_row) - per_row
    parts = attention.windows_of(starts, per_row, window, overlap)
    if apart:
        order = np.argsort(parts[1] > 0, kind="stable")
        parts = tuple(x[order] for x in parts)
    first, skip, length, run = parts
    place = np.arange(window)
    for a in range(0, len(first), size):
        b = slice(a, a + size)
        at = np.minimum(first[b, None] + place, len(flat) - 1)
        before = np.where(at == starts[run[b]][:, None], BOS, flat[at - 1])
        mask = (place >= skip[b, None]) & (place < length[b, None])
        yield before, flat[at], mask, run[b], at


def _id_runs(train: DataFrame, model, frequent, kind: str) -> DataFrame:
    """(draw, key, ids as bytes) of every training document."""

    def cut(batches_in):
        ids = Ids(model.value, *frequent.value[:3])
        for batch in batches_in:
            for chunk in text_chunks(batch.column(0)):
                flat, per_row, _ = ids.runs(chunk)
                data = pa.py_buffer(flat.astype(kind))
                size = np.dtype(kind).itemsize
                offsets = np.concatenate(([0], np.cumsum(per_row * size)))
                runs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), chunk.rows, [None, pa.py_buffer(offsets.astype(np.int64)), data]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(chunk.first, chunk.rows) for i in (1, 2)), runs], names=["draw", "key", "ids"])

    key = F.xxhash64("doc_id", "text")
    draw = F.pmod(key, F.lit(1 << 30)) / float(1 << 30)
    return train.select("text", draw.alias("draw"), key.alias("key")).mapInArrow(cut, "draw double, key long, ids binary")


def _runs(column: pa.Array, kind: str, limit: int = CHUNK_BYTES):
    """(ids, ids per row) of a column of ``_id_runs``, in chunks."""
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        flat = np.frombuffer(column.buffers()[2], np.uint8)[offsets[first] : offsets[last]].view(kind).astype(np.int32)
        yield flat, np.diff(offsets[first : last + 1]) // np.dtype(kind).itemsize
        first = last


def _summed(parts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(slots, sums) of the columns c0.. of all partitions by slot; the driver gets a row a slot."""
    every = parts.groupBy("slot").agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(width)]).toArrow()
    return every.column("slot").to_numpy(), np.stack([every.column(f"c{i}").to_numpy() for i in range(width)], 1)


def _slots(slot: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(np.ascontiguousarray(values[:, i], np.float64)) for i in range(values.shape[1])]
    return pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), *columns], names=["slot", *(f"c{i}" for i in range(values.shape[1]))])


def _slot_schema(width: int) -> str:
    return "slot int, " + ", ".join(f"c{i} double" for i in range(width))


def _shares(flat: np.ndarray, per_row: np.ndarray, column: np.ndarray, top: int):
    """Roots of the shares of the top ids in each row, 200 rows at a time."""
    starts = np.concatenate(([0], np.cumsum(per_row)))
    for a in range(0, len(per_row), 200):
        b = min(len(per_row), a + 200)
        col = column[flat[starts[a] : starts[b]]]
        row = np.repeat(np.arange(b - a), per_row[a:b])[col >= 0]
        x = np.bincount(row * top + col[col >= 0], minlength=(b - a) * top).reshape(b - a, top)
        yield np.sqrt(x / np.maximum(x.sum(1, keepdims=True), 1)).astype(np.float32)


def cluster_counts(spark: SparkSession, runs: DataFrame, per_id: np.ndarray, n_train: int, kind: str, fit_rows: int) -> np.ndarray:
    """(clusters, ids) counts of every training document's ids by its cluster."""
    k, top = attention.CLUSTERS, min(TOP_IDS, len(per_id))
    if n_train <= 4 * k:
        return np.zeros((k, len(per_id)))
    column = np.full(len(per_id), -1)
    column[np.argsort(-per_id, kind="stable")[:top]] = np.arange(top)

    def histograms(batches_in):
        for batch in batches_in:
            for flat, per_row in _runs(batch.column(0), kind):
                for x in _shares(flat, per_row, column, top):
                    yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary())], names=["x"])

    # Where the rounds start: some documents, a row of bounded size each.
    some = runs.where(F.col("draw") < min(1.0, fit_rows / n_train)).select("ids").mapInArrow(histograms, "x binary").toArrow()
    some = sorted(set(some.column("x").to_pylist()))
    if len(some) <= 4 * k:
        return np.zeros((k, len(per_id)))
    x = np.frombuffer(b"".join(some), np.float32).reshape(-1, top)
    label = attention.document_clusters(np.square(x), k)
    centres = np.array([x[label == j].mean(0) if (label == j).any() else x.mean(0) for j in range(k)], np.float32)

    def nearest(x, centres):
        return (attention.rows_times(x, centres.T) - (centres**2).sum(1) / 2).argmax(1)

    size = len(per_id)
    # The last round counts ids by cluster instead of moving the centres once more.
    for last in [False] * (CLUSTER_ROUNDS - 1) + [True]:
        sent = spark.sparkContext.broadcast(centres)

        def assign(batches_in, sent=sent, last=last):
            sums, n = np.zeros((top, k)), np.zeros(k)
            counts = np.zeros(size * k if last else 0)
            for batch in batches_in:
                for flat, per_row in _runs(batch.column(0), kind):
                    own = []
                    for x in _shares(flat, per_row, column, top):
                        own.append(nearest(x, sent.value))
                        if not last:
                            n += np.bincount(own[-1], minlength=k)
                            for j in np.unique(own[-1]):
                                sums[:, j] += x[own[-1] == j].sum(0)
                    if last:
                        counts += np.bincount(flat * k + np.repeat(np.concatenate(own), per_row), minlength=size * k)
            if last:
                every = counts.reshape(size, k)
                seen = np.flatnonzero(every.any(1))
                yield _slots(seen, every[seen])
            else:
                yield _slots(np.arange(top + 1), np.vstack([sums, n]))

        slot, sums = _summed(runs.select("ids").mapInArrow(assign, _slot_schema(k)), k)
        if not last:
            sums = sums[np.argsort(slot)]
            n = sums[-1]
            centres = np.where(n[:, None] > 0, sums[:-1].T / np.maximum(n, 1)[:, None], centres).astype(np.float32)
    per_cluster = np.zeros((k, size))
    per_cluster[:, slot] = sums.T
    return per_cluster


def train_part(net: attention.Attention, columns, kind: str, epochs: int = 1) -> int:
    """Train on every window of the columns of ``_id_runs``; the number of windows."""
    parts, held, shown = [], 0, 0

    def show():
        nonlocal parts, held, shown
        net.fit(*(np.concatenate(x) for x in zip(*parts, strict=True)), epochs=epochs, seed=5 + shown)
        shown, parts, held = shown + held, [], 0

    for ids in columns:
        for flat, per_row in _runs(ids, kind):
            for before, target, mask, _, _ in batches(flat, per_row, attention.WINDOW, attention.OVERLAP):
                parts.append((before, target, mask.astype(np.float32)))
                held += len(before)
                if held >= (BUFFER if epochs == 1 else 10 * BUFFER):
                    show()
    if held:
        show()
    return shown


def fit_model(
    spark: SparkSession, train: DataFrame, n_train: int, model, frequent, per_id: np.ndarray, starts_word: np.ndarray, fit_rows: int, seed_ids: int
) -> attention.Tables:
    """Classes from the corpus counts of ids and clusters, attention weights from all windows."""
    kind = "<u2" if len(per_id) <= 1 << 16 else "<i4"
    runs = stored(spark, _id_runs(train, model, frequent, kind), "id_runs")
    classes = attention.classes_of(per_id, starts_word, cluster_counts(spark, runs, per_id, n_train, kind, fit_rows))
    net = attention.Attention(len(per_id), *classes)
    net.begin(per_id)
    total = int(per_id.sum())
    share = min(1.0, seed_ids / max(1, total))
    shown = min(total, seed_ids) / (attention.WINDOW - attention.OVERLAP)
    epochs = int(max(1, min(20, 30_000 // max(1, shown))))
    d = net.dim

    def learn(part: DataFrame, epochs: int) -> None:
        sent = spark.sparkContext.broadcast((classes, net.p, net.state))

        def work(batches_in):
            classes, p, state = sent.value
            own = attention.Attention(len(classes[0]), *classes)
            own.p, own.state = ({k: v.copy() for k, v in x.items()} for x in (p, state))
            n = train_part(own, (b.column(0) for b in batches_in), kind, epochs)
            if n:
                change = np.hstack([own.rows(own.p) - own.rows(p), own.rows(own.state) - own.rows(state)])
                slot = np.flatnonzero(change.any(1))
                yield _slots(slot, np.hstack([change[slot] * float(n), np.full((len(slot), 1), float(n))]))

        slot, sums = _summed(part.select("ids").mapInArrow(work, _slot_schema(2 * d + 1)), 2 * d + 1)
        change = sums[:, :-1] / np.maximum(sums[:, -1:], 1)
        weights, state = net.rows(net.p), net.rows(net.state)
        weights[slot] += change[:, :d].astype(np.float32)
        state[slot] += change[:, d:].astype(np.float32)
        net.load(weights, state)
        sent.unpersist()

    if total:
        # One task for the share of bounded size; its rows in a fixed order.
        learn(runs.where(F.col("draw") < share).repartition(1).sortWithinPartitions("key"), epochs)
    for i in range(ROUNDS if share < 1 else 0):
        low, high = (share + (1 - share) * j / ROUNDS for j in (i, i + 1))
        mine = F.col("draw") >= low
        learn(runs.where(mine if i == ROUNDS - 1 else mine & (F.col("draw") < high)), 1)
    return net.tables()


def spelt_scores(net: attention.Tables, flat: np.ndarray, per_row: np.ndarray, tokens: np.ndarray, last: np.ndarray) -> np.ndarray:
    """ln P by its ids of each word or end of a chunk.

    ``tokens``: ids of each; ``last``: ends.
    """
    lp, start = np.zeros(len(flat), np.float32), np.zeros(len(flat), np.float32)
    for before, target, mask, _, at in batches(flat, per_row, attention.WINDOW, attention.OVERLAP, SCORED, apart=True):
        at = at[mask]
        lp[at], start[at] = net.log_probabilities(before, target, mask)
    first = np.cumsum(tokens) - tokens
    spelt = np.add.reduceat(lp, first, dtype=np.float64) - start[first]
    spelt[:-1] += np.where(last[:-1], 0.0, start[first[1:]])
    return spelt


def _frequent_words(common: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ascending hashes, offsets and ids, log10 of count + 1) of (hash, n, ids) rows."""
    if not common.num_rows:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0)
    table = common.combine_chunks()
    hashes = table.column("hash").to_numpy().view(np.uint64)
    order = np.argsort(hashes, kind="stable")
    lists = table.column("ids").combine_chunks()
    lists = lists.take(pa.array(order)) if isinstance(lists, pa.Array) else lists.chunk(0).take(pa.array(order))
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    return hashes[order], offsets - offsets[0], np.asarray(lists.flatten(), dtype=np.int32), np.log10(table.column("n").to_numpy()[order] + 1.0)


def score_documents(
    spark: SparkSession,
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    model_path: str = MODEL_PATH,
    frequent: int = FREQUENT,
    fit_rows: int = FIT_ROWS,
    seed_ids: int = SEED_IDS,
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row."""
    with open(model_path, "rb") as file:  # the driver's own file, a few hundred KB
        model = spark.sparkContext.broadcast(file.read())
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col, 7, 2).alias("held_out"), F.col(text_col).alias("text"))
    train = rows.where(~F.col("held_out"))

    counts = stored(spark, word_counts(train), "words")
    n_train = train.count()

    def cut(batches_in):
        ids = Ids(model.value)
        for batch in batches_in:
            for at in range(0, batch.num_rows, 20_000):
                part = batch.slice(at, 20_000)
                chunk = next(iter(text_chunks(part.column(0), 1 << 40)))
                offsets, flat = ids.encode(part.column(0))
                hashes = words_of(chunk, NOT_SPACE).hash
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), part.column(1), lists], names=["hash", "n", "ids"])

    words = stored(spark, counts.mapInArrow(cut, "hash long, n long, ids array<int>"), "word_ids")

    # Sizes, and how many words there are of each magnitude.
    scale = F.floor(F.log2("n"))
    sizes = words.groupBy(scale.alias("s")).agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("n")).collect()
    total = sum(r["n"] for r in sizes) + n_train
    kinds = sum(r["words"] for r in sizes) + (1 if n_train else 0)
    least, got = 64, 0
    for r in sorted(sizes, key=lambda r: -r["s"]):
        if got + r["words"] > frequent:
            break
        got, least = got + r["words"], r["s"]
    common = words.where(scale >= least).toArrow()
    rare = words.where(scale < least).select("hash", "n")

    # The attention model: classes from all counts, weights from all windows.
    id_counts = words.select(F.explode("ids").alias("id"), "n").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    per_id = np.zeros(Ids(model.value).encoder.get_piece_size(), np.int64)
    per_id[id_counts.column("id").to_numpy()] = id_counts.column("n").to_numpy()
    per_id[END] += n_train
    encoder = Ids(model.value).encoder
    starts_word = np.array([i in (BOS, END) or encoder.id_to_piece(i).startswith("\u2581") for i in range(len(per_id))])
    sent = spark.sparkContext.broadcast(_frequent_words(common))
    tables = fit_model(spark, train, n_train, model, sent, per_id, starts_word, fit_rows, seed_ids)
    smooth = float(np.log10(total + kinds + 1.0))
    end_log = float(np.log10(n_train + 1.0))

    net_parts = spark.sparkContext.broadcast({f.name: getattr(tables, f.name) for f in fields(tables)})

    def judge(batches_in):
        *known, log_of = sent.value
        net = attention.Tables(**net_parts.value)
        ids = Ids(model.value, *known)
        for batch in batches_in:
            for chunk in text_chunks(batch.column("text"), 2 << 20):
                flat, per_row, w = ids.runs(chunk)
                hit = w.place >= 0
                log = np.zeros(len(hit))
                log[hit] = log_of[w.place[hit]]
                base = np.bincount(w.row, log, chunk.rows).astype(np.float64)
                n_known = np.bincount(w.row[hit], minlength=chunk.rows)
                # Words and ends in text order, ends last in their rows.
                n_words = np.bincount(w.row, minlength=chunk.rows)
                last = np.zeros(len(w.hash) + chunk.rows, bool)
                last[np.cumsum(n_words + 1) - 1] = True
                counted = np.full(len(last), end_log)
                counted[~last] = log
                tokens = np.ones(len(last), np.int64)
                tokens[~last] = w.tokens
                spelt = spelt_scores(net, flat, per_row, tokens, last)
                each = np.logaddexp(spelt, (counted - smooth) * np.log(10.0)) - np.log(2.0)
                lm = np.bincount(np.repeat(np.arange(chunk.rows), n_words + 1), each, chunk.rows).astype(np.float64)
                r, h = w.row[~hit], w.hash[~hit]
                by = np.lexsort((h, r))
                r, h, own_spelt = r[by], h[by], spelt[~last][~hit][by]
                new = np.ones(len(r), bool)
                new[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
                place = np.flatnonzero(new)
                spans = pa.array(np.append(place, len(r)).astype(np.int32))
                cuts = pa.array(np.searchsorted(r[place], np.arange(chunk.rows + 1)).astype(np.int32))
                own = batch.slice(chunk.first, chunk.rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        own.column("row"), own.column("doc_id"), own.column("held_out"),
                        pa.array(n_words.astype(np.int64) + 1), pa.array(n_known.astype(np.int64)),
                        pa.array(base), pa.array(lm / np.log(10.0)),
                        pa.ListArray.from_arrays(cuts, pa.array(h[place].view(np.int64))),
                        pa.ListArray.from_arrays(cuts, pa.ListArray.from_arrays(spans, pa.array(own_spelt))),
                    ],
                    names=["row", "doc_id", "held_out", "n_tokens", "common", "base", "score", "hashes", "spelt"],
                )

    id_type = rows.schema["doc_id"].dataType.simpleString()
    scored = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text").mapInArrow(
        judge,
        f"row long, doc_id {id_type}, held_out boolean, n_tokens long, common long, base double, score double, hashes array<long>, spelt array<array<double>>",
    )
    scored = stored(spark, scored, "scored")
    pairs = scored.select("row", F.explode(F.arrays_zip("hashes", "spelt")).alias("p"))

    def mixed(spelt, unigram):
        """ln(P by ids + P alone), from the logarithms of both."""
        return F.greatest(spelt, unigram) + F.log1p(F.exp(-F.abs(spelt - unigram)))

    ln10 = float(np.log(10.0))
    alone = (F.log10(F.col("n") + 1.0) - smooth) * ln10
    # What the true count adds to the score that took the word as unseen.
    lift = F.aggregate("spelt", F.lit(0.0), lambda a, x: a + mixed(x, F.col("alone")) - mixed(x, F.lit(-smooth * ln10)))
    times = F.size("spelt")
    found = (
        pairs.select("row", F.col("p.hashes").alias("hash"), F.col("p.spelt").alias("spelt"))
        .join(rare.select("hash", "n", alone.alias("alone")), "hash")
        .groupBy("row")
        .agg(
            F.sum(times * F.log10(F.col("n") + 1.0)).alias("more"), F.sum(times).alias("seen"),
            # Fixed point: the sum does not depend on the order of the words.
            F.sum((lift / ln10).cast("decimal(24,12)")).cast("double").alias("lift"),
        )
    )
    end_known = 1 if n_train else 0
    base = F.col("base") + F.coalesce("more", F.lit(0.0)) + end_log - F.col("n_tokens") * smooth
    return scored.join(found, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("common") + F.coalesce("seen", F.lit(0)) + end_known).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"),
        (F.col("score") + F.coalesce("lift", F.lit(0.0))).alias("score"),
    )
