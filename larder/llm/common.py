"""Helpers shared by the operators: Arrow text access, word hashes, tables.

Python tasks receive Arrow record batches (``mapInArrow``).  ``text_chunks``
exposes the UTF-8 bytes of a text column as one numpy array per bounded chunk,
so that hashing runs over whole arrays and no document becomes a Python string
unless an operator needs one.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.session import scratch_path

#: Bytes of text handled at once inside a task (one longer document goes alone).
CHUNK_BYTES = 1 << 20
#: Bytes hashed at once; a document above this is hashed piece by piece.
PIECE_BYTES = 1 << 20

# splitmix64 finaliser constants (fixed values)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back.

    Cuts the lineage at expensive Python stages: a lost executor makes Spark
    reread files, not recompute the corpus.
    """
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Freed memory of this process goes back to the system.

    Workers live on from task to task and from stage to stage; what the C library
    and Arrow keep for later use would add up over the workers of an executor.
    """
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not the GNU C library
        pass


def tidy(task: Callable) -> Callable:
    """A ``mapInArrow`` function that gives freed memory back when its task ends."""

    @wraps(task)
    def run(batches):
        try:
            yield from task(batches)
        finally:
            give_back()

    return run


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that do not clash (in any case) with those of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def columns(df: DataFrame) -> list:
    """All columns of ``df`` as they are, whatever characters their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def with_fields(df: DataFrame, fields: list[tuple[str, T.DataType]]) -> T.StructType:
    return T.StructType(list(df.schema.fields) + [T.StructField(n, t) for n, t in fields])


def extended(batch: pa.RecordBatch, names: list[str], arrays: list[pa.Array]) -> pa.RecordBatch:
    """The batch with more columns at its end."""
    return pa.RecordBatch.from_arrays(list(batch.columns) + arrays, names=list(batch.schema.names) + names)


def held_out(col: str, modulus: int, remainder: int = 0):
    """Whether crc32 of the id, written as text, leaves ``remainder``; null ids are never held out."""
    return F.coalesce(F.crc32(F.col(col).cast("string")) % modulus == remainder, F.lit(False))


@dataclass
class Chunk:
    """Rows ``[first, last)`` of a batch: text bytes and per-row offsets into them."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return self.last - self.first


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null row has no bytes."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if offs is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offs, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if column.null_count:
        # A null slot may in theory span bytes; drop them from the view.
        lengths = np.diff(offsets)
        if lengths[np.asarray(column.is_null())].any():
            column = column.fill_null("")
            return text_bytes(pa.concat_arrays([column]))
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    data, offsets = text_bytes(column)
    first, n = 0, len(column)
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(n, max(last, first + 1))
        a, b = offsets[first], offsets[last]
        yield Chunk(first, last, data[a:b], offsets[first : last + 1] - a)
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser over uint64."""
    x = x + _GOLDEN
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _lut(inside) -> np.ndarray:
    out = np.zeros(256, bool)
    for b in range(256):
        out[b] = inside(b)
    return out


#: Digits, ASCII letters and every byte of a non-ASCII character.
ALNUM = _lut(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)
#: Everything but ASCII white space.
NOT_SPACE = _lut(lambda b: not (b == 32 or 9 <= b <= 13))
#: Bytes as they are, and A-Z as a-z.
SAME = np.arange(256, dtype=np.uint8)
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


@dataclass
class Words:
    """Words of a chunk in order: byte range, owning row, 64-bit hash."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    #: Subword ids of each word, where a caller has counted them.
    tokens: np.ndarray | None = None
    #: Place of each word in a caller's table, or -1.
    place: np.ndarray | None = None


def words_of(chunk: Chunk, inside: np.ndarray) -> Words:
    """Maximal runs of ``inside`` bytes; hashes ignore the case of A-Z."""
    data, offsets = chunk.data, chunk.offsets
    if len(data) == 0:
        z = np.zeros(0, np.int64)
        return Words(z, z, z, np.zeros(0, np.uint64))
    flag = inside[data]
    begin = flag.copy()
    begin[1:] &= ~flag[:-1]
    stop = flag.copy()
    stop[:-1] &= ~flag[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begin[edges] |= flag[edges]
    stop[edges - 1] |= flag[edges - 1]
    start = np.flatnonzero(begin)
    end = np.flatnonzero(stop) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    return Words(start, end, row, span_hashes(data, start, end, LOWER))


def span_texts(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Each [start, end) of the bytes as a string column, A-Z lower-cased."""
    size = end - start
    offsets = np.concatenate(([0], np.cumsum(size)))
    place = np.repeat(start - offsets[:-1], size) + np.arange(int(offsets[-1]))
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(LOWER[data[place]]))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """Polynomial hash of each [start, end) of ``fold[data]``, mixed; pieces bound the memory."""
    out = np.zeros(len(start), np.uint64)
    lo = 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(end, start[lo] + PIECE_BYTES, "right")))
        s, e = start[lo:hi], end[lo:hi]
        sizes = e - s
        first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        within = np.arange(int(sizes.sum()), dtype=np.int64) - np.repeat(first, sizes)
        powers = np.full(int(sizes.max()), _BASE, np.uint64)
        powers[0] = 1
        powers = np.cumprod(powers, dtype=np.uint64)
        letters = fold[data[within + np.repeat(s, sizes)]].astype(np.uint64) + np.uint64(1)
        out[lo:hi] = np.add.reduceat(letters * powers[within], first)
        lo = hi
    return mix(out)
