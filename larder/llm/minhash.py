"""Near-duplicate documents by DartMinHash signatures and banded joining.

A document is the weighted set of its runs of five words (words: A-Z
lower-cased runs of digits, letters and non-ASCII characters; fewer than five
words form one run).  ``weights="presence"`` gives every run weight 1, so that
signatures agree at a coordinate with the Jaccard similarity of the sets, the
contract's measure; ``weights="count"`` weighs by occurrences.

DartMinHash.  The plane (weight x rank) of every element is cut into unit
cells; a cell holds a Poisson(1) number of darts, all drawn from hashes of
(element, cell), hence the same in every document.  A dart counts if its
weight coordinate lies below the element's weight in the document; it carries
a signature coordinate and a rank, and a coordinate keeps its dart of smallest
rank.  Ranks are thrown in doubling strata only until every coordinate is
filled, so a document of n runs costs about max(n, k log k) darts and not n*k.

Joining.  Documents of equal text are one node (``node``: xxhash64 of the
text, 64 bits).  A signature gives ``bands`` keys.  Buckets of at least two
nodes are kept; the centre of a bucket is its member of greatest popularity
(sum of the sizes of its buckets: the text that the others were copied from
keeps the commonest keys).  Members are compared with their centre only, by
the exact similarity of their runs; accepted links are contracted to
components.  In buckets whose members then still lie in different components,
some rounds compare the members outside the largest component with one of its
members each; what is apart after that is compared across components, screened
inside the join by the agreement of longer signatures, so that a large group
of merely related texts yields few pairs.

Results: one row per input row with ``class_id``, the smallest doc_id of its
class, and ``n_links``, the number of accepted comparisons of its text.
Null and empty texts are each their own class; texts without any word form
classes of equal texts.  Repeated rows share a class.  A null doc_id joins a
class but names it only if no member has an id.  An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.llm.common import ALNUM, columns, free_names, mix, stored, text_chunks, tidy, words_of
from larder.llm.components import components

RUN = 5
SIMILARITY = 0.8
#: 25 bands of 5 coordinates: a pair at similarity 0.8 is found with
#: probability 1 - (1 - 0.8**5)**25 > 0.9999.
BANDS = 25
ROWS = 5
#: Rounds of comparison with members of a bucket's largest component.
ROUNDS = 2
#: Coordinates of the signature that screens pairs across components.
SKETCH = 256

# P(Poisson(1) <= n) as thresholds of a uniform 64-bit hash.
_POISSON = np.array(
    [min(int(sum(math.exp(-1) / math.factorial(j) for j in range(n + 1)) * 2.0**64), 2**64 - 1) for n in range(18)],
    np.uint64,
)
# Odd multipliers that keep cells, darts and coordinates apart (own choice).
_CELL_W = np.uint64(0xD6E8FEB86659FD93)
_CELL_R = np.uint64(0xA0761D6478BD642F)
_DART = np.uint64(0xE7037ED1A0B428DB)
_COORD = np.uint64(0x8EBC6AF09C88C6E3)
_STEP = np.uint64(0x589965CC75374CC3)


def runs_of(words, n_rows: int, size: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every run of ``size`` words; short rows give one run of all."""
    h, row = words.hash, words.row
    per_row = np.bincount(row, minlength=n_rows)
    first = np.concatenate(([0], np.cumsum(per_row)))
    at = np.arange(len(h))
    left = first[row + 1] - at if len(h) else at
    full = at[left >= size]
    total = np.zeros(len(full), np.uint64)
    for j in range(size):
        total = (total + h[full + j]) * _STEP
    rows, hashes = [row[full]], [mix(total)]
    for n in range(1, size):
        start = first[:-1][per_row == n]
        total = np.zeros(len(start), np.uint64)
        for j in range(n):
            total = (total + h[start + j]) * _STEP
        rows.append(row[start])
        hashes.append(mix(total + np.uint64(n)))
    return np.concatenate(rows), np.concatenate(hashes)


def weighted(row: np.ndarray, element: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, element) with their number of occurrences as weight."""
    order = np.lexsort((element, row))
    row, element = row[order], element[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (element[1:] != element[:-1])
    at = np.flatnonzero(new)
    return row[at], element[at], np.diff(np.append(at, len(row))).astype(np.float64)


def _times(x: np.uint64, n: int) -> np.uint64:
    return np.uint64(int(x) * n & 0xFFFFFFFFFFFFFFFF)


def dart_signatures(row: np.ndarray, element: np.ndarray, weight: np.ndarray | None, n_rows: int, k: int) -> np.ndarray:
    """(n_rows, k) winning darts; rows without elements stay 0.  ``weight=None``: all 1."""
    sig = np.zeros(n_rows * k, np.uint64)
    alive = np.zeros(n_rows, bool)
    alive[row] = True
    filled = np.zeros(n_rows * k, bool)
    low, high = 0, 1
    while alive.any():
        use = alive[row]
        r, e = row[use], element[use]
        w = None if weight is None else weight[use]
        best = np.full(n_rows * k, np.inf)
        found = []
        for j in range(low, high):  # unit rank cells of this stratum
            if w is None:
                cr, key, limit = r, e, None
            else:  # one unit weight cell per started unit of weight
                n = np.ceil(w).astype(np.int64)
                i = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                cr, key = np.repeat(r, n), np.repeat(e, n) + i.astype(np.uint64) * _CELL_W
                limit = np.repeat(w, n) - i
            cell = mix(key + _times(_CELL_R, j))
            darts = np.searchsorted(_POISSON, cell, "right")
            for d in range(int(darts.max(initial=0))):
                has = darts > d
                v = mix(cell[has] + _times(_DART, d + 1))
                at = cr[has]
                if limit is not None:
                    inside = (mix(v ^ _CELL_W) >> np.uint64(11)) * 2.0**-53 < limit[has]
                    v, at = v[inside], at[inside]
                place = at * k + ((mix(v ^ _COORD) >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
                rank = j + (v >> np.uint64(11)) * 2.0**-53
                np.minimum.at(best, place, rank)
                found.append((place, rank, v))
        for place, rank, v in found:
            won = (rank == best[place]) & ~filled[place]
            sig[place[won]] = v[won]
        filled |= best < np.inf
        alive &= ~filled.reshape(n_rows, k).all(1)
        low, high = high, high * 2
    return sig.reshape(n_rows, k)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(n, bands) signed 64-bit keys."""
    out = np.empty((len(sig), bands), np.uint64)
    for b in range(bands):
        total = np.full(len(sig), b + 1, np.uint64)
        for j in range(rows):
            total = mix((total ^ sig[:, b * rows + j]) * _STEP)
        out[:, b] = total
    return out.view(np.int64)


def signatures(docs: DataFrame, *, bands: int, rows: int, size: int, weights: str) -> DataFrame:
    """(node, bands) of each row of (node, text); rows without words are left out."""
    k = bands * rows

    def sign(batches):
        for batch in batches:
            node = batch.column(0)
            for chunk in text_chunks(batch.column(1)):
                row, run = runs_of(words_of(chunk, ALNUM), chunk.rows, size)
                w = None
                if weights == "count":
                    row, run, w = weighted(row, run)
                elif weights != "presence":
                    raise ValueError(f"unknown weights {weights!r}")
                some = np.unique(row)
                keys = band_keys(dart_signatures(row, run, w, chunk.rows, k)[some], bands, rows)
                offsets = pa.array(np.arange(len(some) + 1, dtype=np.int32) * bands)
                yield pa.RecordBatch.from_arrays(
                    [node.take(pa.array(some + chunk.first)), pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))],
                    names=["node", "bands"],
                )

    return docs.select("node", "text").mapInArrow(tidy(sign), "node long, bands array<long>")


def run_sets(docs: DataFrame, *, size: int, weights: str) -> DataFrame:
    """(node, runs, times, sketch): the sorted distinct runs, their hashes cut to
    32 bits, with occurrences; a signature of ``SKETCH`` coordinates, 8 bits each."""

    def sets(batches):
        for batch in batches:
            node = batch.column(0)
            for chunk in text_chunks(batch.column(1)):
                row, run = runs_of(words_of(chunk, ALNUM), chunk.rows, size)
                row, run_full, w = weighted(row, run)
                run = run_full >> np.uint64(32)
                cuts = np.searchsorted(row, np.arange(chunk.rows + 1))
                runs, counts = run.astype("<u4"), w.astype("<u4")
                marks = dart_signatures(row, run_full, w if weights == "count" else None, chunk.rows, SKETCH)
                sketch = pa.ListArray.from_arrays(
                    pa.array(np.arange(chunk.rows + 1, dtype=np.int32) * SKETCH), pa.array((marks & np.uint64(255)).astype(np.uint8).view(np.int8).ravel())
                )
                values = [runs[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                times = [counts[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [node.slice(chunk.first, chunk.rows), pa.array(values, pa.binary()), pa.array(times, pa.binary()), sketch],
                    names=["node", "runs", "times", "sketch"],
                )

    return docs.select("node", "text").mapInArrow(tidy(sets), "node long, runs binary, times binary, sketch array<tinyint>")


def similarity(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray, weights: str) -> float:
    """Weighted Jaccard of two sorted run sets."""
    if weights == "presence":
        both = len(np.intersect1d(a, b, assume_unique=True))
        return both / max(1, len(a) + len(b) - both)
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    both = float(np.minimum(wa[i], wb[j]).sum())
    return both / max(1.0, float(wa.sum()) + float(wb.sum()) - both)


def accepted(pairs: DataFrame, sets: DataFrame, threshold: float, weights: str) -> DataFrame:
    """The pairs (a, b) whose exact similarity reaches the threshold."""
    left = sets.select(F.col("node").alias("a"), F.col("runs").alias("ra"), F.col("times").alias("ta"))
    right = sets.select(F.col("node").alias("b"), F.col("runs").alias("rb"), F.col("times").alias("tb"))

    def judge(batches):
        for batch in batches:
            ra, ta, rb, tb = (batch.column(c) for c in ("ra", "ta", "rb", "tb"))
            keep = []
            for i in range(batch.num_rows):
                x = [np.frombuffer(c[i].as_buffer(), "<u4") for c in (ra, ta, rb, tb)]
                keep.append(similarity(*x, weights) >= threshold)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "ra", "ta", "rb", "tb")
    return joined.mapInArrow(tidy(judge), "a long, b long")


def near_duplicates(
    spark: SparkSession,
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = RUN,
    threshold: float = SIMILARITY,
    bands: int = BANDS,
    rows: int = ROWS,
    weights: str = "presence",
    rounds: int = ROUNDS,
) -> tuple[DataFrame, DataFrame]:
    """((doc_id, node, root, class_id, n_links) per row, links (a, b) between nodes).

    ``node`` and ``root`` (the class's smallest node) are null for null and
    empty texts.
    """
    node = F.when(F.length(text_col) > 0, F.xxhash64(text_col))
    rows_in = docs.select(F.col(id_col).alias("doc_id"), node.alias("node"), F.col(text_col).alias("text"))
    keyed = rows_in.where("node is not null")

    banded = stored(spark, signatures(keyed, bands=bands, rows=rows, size=size, weights=weights), "bands")
    keys = banded.select("node", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("key")
    members = stored(spark, keys.join(shared, "key").distinct(), "members")

    size_of = members.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    popular = members.join(size_of, "key").groupBy("node").agg(F.sum("size").alias("popular"))
    ranked = members.join(popular, "node")
    centres = ranked.groupBy("key").agg(F.max_by("node", F.struct("popular", "node")).alias("c"))
    star = (
        members.join(centres, "key")
        .where("node <> c")
        .select(F.least("node", "c").alias("a"), F.greatest("node", "c").alias("b"))
        .distinct()
    )
    star = stored(spark, star, "pairs")

    # Runs of the candidates only: one row per node (the smallest id's text).
    wanted = members.select("node").distinct()
    chosen = (
        docs.select(F.col(id_col).alias("doc_id"), node.alias("node"))
        .where("node is not null")
        .groupBy("node")
        .agg(F.min("doc_id").alias("doc_id"))
        .join(wanted, "node", "left_semi")
    )
    picked = keyed.join(chosen.withColumnsRenamed({"node": "n", "doc_id": "d"}), (F.col("node") == F.col("n")) & F.col("doc_id").eqNullSafe(F.col("d")), "left_semi")
    sets = stored(spark, run_sets(picked, size=size, weights=weights), "runs").dropDuplicates(["node"])
    links = stored(spark, accepted(star, sets, threshold, weights), "links")
    labels = components(spark, links)

    def apart(rows: DataFrame, labels: DataFrame) -> DataFrame:
        """(key, node, label) of the buckets of ``rows`` with members in different components."""
        marked = rows.select("key", "node").join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
        split = marked.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key")
        return stored(spark, marked.join(split, "key"), "mixed")

    def tested(pairs: DataFrame) -> DataFrame:
        """Untested pairs (a, b), judged; the pairs become known."""
        nonlocal known
        fresh = stored(spark, pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(known, ["a", "b"], "left_anti"), "pairs")
        known = known.union(fresh)
        return stored(spark, accepted(fresh, sets, threshold, weights), "links")

    # Members outside the largest component of their bucket meet one member of
    # it, another one each round: a linear number of pairs.
    known, mixed = star, apart(members, labels)
    for turn in range(rounds):
        groups = mixed.groupBy("key", "label").agg(
            F.count(F.lit(1)).alias("n"), F.max_by("node", F.xxhash64("node", "key", F.lit(turn))).alias("c")
        )
        largest = groups.groupBy("key").agg(F.max(F.struct("n", "label", "c")).alias("g")).select("key", "g.label", "g.c")
        largest = largest.withColumnRenamed("label", "other")
        more = tested(mixed.join(largest, "key").where("label <> other").select(F.col("node").alias("a"), F.col("c").alias("b")))
        if not more.limit(1).count():
            break
        links = links.union(more)
        labels = components(spark, links)
        mixed = apart(mixed, labels)

    # What is still apart is compared across the components.  The sketches
    # screen inside the join: a pair at the threshold agrees in fewer
    # coordinates than asked for with probability 0.0002.
    k = SKETCH
    need = int(k * threshold - 3.5 * math.sqrt(k * threshold * (1 - threshold)))
    # A pair that shares several keys is listed at the smallest one only.
    keys_of = banded.join(mixed.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])
    ours = mixed.join(sets.select("node", "sketch"), "node").join(keys_of, "node")
    left = ours.select("key", F.col("node").alias("a"), "label", "sketch", "bands")
    right = ours.select(
        "key", F.col("node").alias("b"), F.col("label").alias("label2"), F.col("sketch").alias("sketch2"), F.col("bands").alias("bands2")
    )
    agree = F.aggregate(F.zip_with("sketch", "sketch2", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    first = F.array_min(F.array_intersect("bands", "bands2")) == left["key"]
    across = left.join(right, (left["key"] == right["key"]) & (F.col("label") < F.col("label2")) & (agree >= need) & first)
    more = tested(across.select("a", "b"))
    if more.limit(1).count():
        links = links.union(more)
        labels = components(spark, links)

    degree = links.select(F.col("a").alias("node")).union(links.select("b")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    graph = labels.join(degree, "node", "left")
    placed = (
        docs.select(F.col(id_col).alias("doc_id"), node.alias("node"))
        .join(graph, "node", "left")
        .select("doc_id", "node", F.coalesce("label", "node").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )
    names = placed.groupBy("root").agg(F.min("doc_id").alias("class_id")).where("root is not null")
    result = placed.join(names, "root", "left").select(
        "doc_id", "node", "root", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), "n_links"
    )
    return result, links


def keep_first(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without near copies: of each class the row with the smallest id.

    Rows whose text is null or empty all stay.  Of rows repeated under the kept
    id the one with the smallest hash over all columns stays.  The kept (text,
    id) pairs are joined with the rows on both, so that copies of one text
    spread over the tasks.
    """
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    classes, _ = near_duplicates(spark, docs, **options)
    # Two texts of a class may carry the same id: the smaller node is kept.
    kept = (
        classes.where("node is not null and doc_id <=> class_id")
        .groupBy("root")
        .agg(F.min(F.struct("node", "class_id")).alias("kept"))
        .select(F.col("kept.node").alias("kept_node"), F.col("kept.class_id").alias("kept_id"))
    )
    mark, order = free_names(docs, "node", "rank")
    rows = docs.withColumn(mark, F.when(F.length(text_col) > 0, F.xxhash64(text_col)))
    plain = [c for c, t in zip(columns(docs), docs.dtypes, strict=True) if "map<" not in t[1]]  # maps have no hash
    copies = Window.partitionBy(mark, id_col).orderBy(F.xxhash64(*plain))
    first = (
        rows.where(F.col(mark).isNotNull())
        .join(kept, (F.col(mark) == F.col("kept_node")) & F.col(id_col).eqNullSafe(F.col("kept_id")), "left_semi")
        .withColumn(order, F.row_number().over(copies))
        .where(F.col(order) == 1)
    )
    return first.select(columns(docs)).union(rows.where(F.col(mark).isNull()).select(columns(docs)))


def near_duplicate_classes(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The registered query: (doc_id, class_id, n_links)."""
    return near_duplicates(spark, docs)[0].select("doc_id", "class_id", "n_links")
