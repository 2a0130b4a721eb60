"""Exact top-k search over binary codes by incremental multi-index hashing.

A vector's code has one bit per dimension (1: the component is positive).
Codes are cut into segments of about log2(block size) bits, and every block of
the index holds a table per segment: value -> codes.  A query looks up, segment
after segment, all values within radius r of its own; r grows.  After segment j
at radius r every code within Hamming distance ``m * r + j`` has been met (a
code farther than r in segments 0..j and farther than r - 1 in the others
differs in at least ``m * r + j + 1`` bits).  The query ends as soon as its
k-th verified distance is covered, so the result is exact, ties included.

Equal codes are one entry of the index (with its k smallest ids) and one
query, so groups of equal vectors cost nothing extra.  Index and queries are
dealt by hash into blocks.  A task builds the tables of an index block once and
streams the queries of a query block past them; a query costs what it meets, not
the block's size.  The k best of every block are merged.

Results: per query k rows by (distance, id), the query itself among them.  Rows
without an id or a vector take no part; a null component is a 0 bit, as are
dimensions that a vector lacks; repeated rows count once; an id with several
vectors is indexed, and asked for, by each of them.  With fewer than k rows all
are returned.  An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.llm.common import stored

K = 10
INDEX_BLOCK = 1 << 13
#: An entry of the index is copied once for so many queries.
QUERY_BLOCK = 1 << 17
#: Partitions that the pairs of blocks are dealt to, at most.
MAX_PARTITIONS = 20_000
#: Queries searched together inside a task.
BATCH = 128


def codes_of(vectors: DataFrame, id_col: str, vector_col: str, dims: int) -> DataFrame:
    """(id, code binary) of the rows that have both."""
    width = -(-dims // 8)

    def pack(batches):
        for batch in batches:
            lists = batch.column(1)
            lists = lists if pa.types.is_list(lists.type) else lists.cast(pa.list_(lists.type.value_type))
            offsets = np.asarray(lists.offsets, dtype=np.int64)
            values = lists.values.fill_null(0).to_numpy(zero_copy_only=False)
            bits = np.zeros((batch.num_rows, dims), np.uint8)
            size = np.diff(offsets)
            row = np.repeat(np.arange(batch.num_rows), size)
            col = np.arange(offsets[0], offsets[-1]) - np.repeat(offsets[:-1], size)
            bits[row, col] = values[offsets[0] : offsets[-1]] > 0
            packed = np.packbits(bits, axis=1)
            codes = pa.Array.from_buffers(
                pa.binary(width), batch.num_rows, [None, pa.py_buffer(np.ascontiguousarray(packed))]
            ).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), codes], names=["id", "code"])

    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id is not null and v is not null")
    return rows.mapInArrow(pack, "id long, code binary")


def _segments(codes: np.ndarray, cuts: list[tuple[int, int]]) -> list[np.ndarray]:
    """Values of the bit ranges ``cuts`` of (n, width) byte codes."""
    bits = np.unpackbits(codes, axis=1).astype(np.int64)
    return [bits[:, a:b] @ (1 << np.arange(b - a, dtype=np.int64)) for a, b in cuts]


def _masks(size: int, radius: int) -> np.ndarray:
    return np.array([sum(1 << i for i in c) for c in combinations(range(size), radius)], np.int64)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(1, dtype=np.int64)


def segment_tables(codes: np.ndarray) -> tuple[list[tuple[int, int]], list[tuple[np.ndarray, np.ndarray]]]:
    """(bit ranges, per range the codes sorted by its value and where each value starts) of a block."""
    n, dims = len(codes), codes.shape[1] * 8
    size = int(np.clip(np.ceil(np.log2(max(n, 2))), 4, 16))
    m = -(-dims // size)
    edges = np.linspace(0, dims, m + 1).astype(int).tolist()
    cuts = list(zip(edges[:-1], edges[1:], strict=True))
    tables = []
    for value, (a, b) in zip(_segments(codes, cuts), cuts, strict=True):
        order = np.argsort(value, kind="stable")
        tables.append((order, np.searchsorted(value[order], np.arange((1 << (b - a)) + 1))))
    return cuts, tables


def search_block(queries: np.ndarray, codes: np.ndarray, first_id: np.ndarray, k: int, built=None):
    """(query, code, distance) numbers of the k best codes of each query, by (distance, first_id).

    The work of a query is that of the codes that it meets; ``built`` are the
    block's ``segment_tables``.
    """
    n, dims = len(codes), codes.shape[1] * 8
    cuts, tables = segment_tables(codes) if built is None else built
    m = len(cuts)
    out = []
    for at in range(0, len(queries), BATCH):
        part = queries[at : at + BATCH]
        values = _segments(part, cuts)
        far = dims + 1
        # Pairs met so far, as query * n + code, sorted, with their distances.
        met, distance = np.zeros(0, np.int64), np.zeros(0, np.int64)
        counts = np.zeros((len(part), far + 1), np.int64)
        kth = np.full(len(part), far)
        active = np.arange(len(part))
        for step in range(m * (max(b - a for a, b in cuts) + 1)):
            radius, j = divmod(step, m)
            order, starts = tables[j]
            bits = cuts[j][1] - cuts[j][0]
            if radius <= bits:
                probes = values[j][active][:, None] ^ _masks(bits, radius)[None, :]
                begin, stop = starts[probes], starts[probes + 1]
                each = (stop - begin).ravel()
                total = int(each.sum())
                if total:
                    ends = np.cumsum(each)
                    code = order[np.repeat(begin.ravel() - (ends - each), each) + np.arange(total)]
                    # A segment's value has one radius: a pair comes up once a segment.
                    pair = np.sort(np.repeat(active, (stop - begin).sum(1)) * n + code)
                    place = np.searchsorted(met, pair)
                    new = np.ones(len(pair), bool)
                    inside = place < len(met)
                    new[inside] = met[place[inside]] != pair[inside]
                    pair, place = pair[new], place[new]
                    query, code = np.divmod(pair, n)
                    d = _distances(part[query], codes[code])
                    met, distance = np.insert(met, place, pair), np.insert(distance, place, d)
                    np.add.at(counts, (query, d), 1)
            sums = np.cumsum(counts[active], axis=1)
            enough = sums >= min(k, n)
            kth[active] = np.where(enough.any(1), enough.argmax(1), far)
            active = active[kth[active] > step]  # covered so far: m * radius + j = step
            if not len(active):
                break
        query, code = np.divmod(met, n)
        near = distance <= np.minimum(kth, dims)[query]
        query, code, d = query[near], code[near], distance[near]
        rank = np.lexsort((first_id[code], d, query))
        query, code, d = query[rank], code[rank], d[rank]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        keep = place < k
        out.append((query[keep] + at, code[keep], d[keep]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def top_k(
    spark: SparkSession,
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    is_query=None,
    k: int = K,
    index_block: int = INDEX_BLOCK,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """(query_id, rank, neighbor_id, distance) for the rows where ``is_query`` (a column of ``id``)."""
    is_query = F.col("id") % 20 == 0 if is_query is None else is_query
    dims = vectors.agg(F.max(F.size(vector_col))).first()[0] or 0
    dims = max(dims, 1)
    width = -(-dims // 8)
    rows = stored(spark, codes_of(vectors, id_col, vector_col, dims).distinct(), "codes")

    # The k smallest ids of each code; a hot code is thinned out in 64 parts first.
    salted = Window.partitionBy("code", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id")
    inside = Window.partitionBy("code").orderBy("id")
    ids = (
        rows.withColumn("r", F.row_number().over(salted)).where(F.col("r") <= k)
        .withColumn("r", F.row_number().over(inside)).where(F.col("r") <= k)
        .groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    )
    index = stored(spark, ids, "index")
    asked = rows.where(is_query)
    n_index, n_asked = index.count(), asked.select("code").distinct().count()
    blocks, parts = -(-n_index // index_block) or 1, -(-n_asked // query_block) or 1
    some = F.xxhash64("code")
    numbers = lambda n: F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))
    left = index.select(
        F.pmod(some, F.lit(blocks)).alias("block"), F.explode(numbers(parts)).alias("part"),
        "code", F.col("ids")[0].alias("first_id"), F.lit(False).alias("asked"),
    )
    right = asked.select("code").distinct().select(
        F.explode(numbers(blocks)).alias("block"), F.pmod(some, F.lit(parts)).alias("part"),
        "code", F.lit(0).cast("long").alias("first_id"), F.lit(True).alias("asked"),
    )

    names = ["asked_code", "code", "first_id", "distance"]

    def search(batches):
        """Blocks one after the other, each block's entries before its queries."""
        at = None
        entries: list[pa.Table] = []
        built = codes = first_id = column = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            key = np.stack([table.column("block").to_numpy(), table.column("part").to_numpy(), table.column("asked").to_numpy(zero_copy_only=False)], 1)
            edge = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(1)))
            for first, last in zip(edge, np.append(edge[1:], len(key)), strict=True):
                rows = table.slice(int(first), int(last - first))
                here, asked = tuple(key[first, :2].tolist()), bool(key[first, 2])
                if here != at:
                    at, entries, built = here, [], None
                if not asked:
                    entries.append(rows)
                    continue
                if not entries:
                    continue
                if built is None:
                    block = pa.concat_tables(entries).combine_chunks()
                    column, first_id = block.column("code"), block.column("first_id").to_numpy()
                    codes = _matrix(column, width)
                    built = segment_tables(codes)
                q, c, d = search_block(_matrix(rows.column("code"), width), codes, first_id, k, built)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("code").combine_chunks().take(pa.array(q)), column.combine_chunks().take(pa.array(c)), pa.array(first_id[c]), pa.array(d.astype(np.int64))],
                    names=names,
                )

    # A fixed number of partitions: pairs of blocks are few rows but much work,
    # so the run time must not join them by their size.
    dealt = left.union(right).repartition(min(4 * blocks * parts, MAX_PARTITIONS), "block", "part").sortWithinPartitions("block", "part", "asked")
    near = dealt.mapInArrow(search, "asked_code binary, code binary, first_id long, distance long")
    best = Window.partitionBy("asked_code").orderBy("distance", "first_id")
    near = near.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k)
    expanded = near.join(index, "code").select("asked_code", "distance", F.explode("ids").alias("neighbor_id"))
    order = Window.partitionBy("asked_code").orderBy("distance", "neighbor_id")
    lists = expanded.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return (
        asked.select(F.col("id").alias("query_id"), F.col("code").alias("asked_code"))
        .join(lists, "asked_code")
        .select("query_id", "rank", "neighbor_id", "distance")
    )
