"""Phrase collocations by direct-address tiling.

Words are counted per language over the whole table and ranked by frequency.
The grid of (left symbol, right symbol) is split into tiles of ``SIDE`` by
``SIDE`` ranks; the ``TILES`` tiles in which most pairs are to be expected are
counted in each task by ``bincount`` over their cells, all other pairs are
sorted in bounded runs and leave the task as coordinates with counts.  Spark
adds up the counts of both kinds by pair.  Frequent pairs are then ranked
themselves and become the left symbols of the next round, which counts phrases
of three words in the same way, and so on to ``longest``.

Symbols are 64-bit hashes of (language, word), so pairs of different languages
never meet; only the first ``HEAD`` ranks are sent to the tasks (a table of
fixed size), all others need no table.  A phrase can reach ``least`` only if
its words do, and the phrases one word shorter that it starts and ends with: a
bit table of fixed size tells most of those that do not, before anything is
shuffled.  It has no misses, so counts stay exact.

Scores are integers: products are decimals of 38 digits, enough for counts
below 10^16.  The best phrases of a language are cut in ``SHARES`` shares first,
each by a window that Spark limits inside every task, so a language of a third of
all rows sends ``top`` rows a share to one task in the end.

Results: see ``collocations``.  A null text has no words, a null language is
``und`` (and shares its counts with rows marked ``und``).  Repeated rows count
each time; ties end by the phrase's bytes.  A long text is a chunk of its own.
Two words of equal hash and language would count as one in phrases (never in
``n``).  An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.llm.common import Chunk, mix, span_texts, stored, text_chunks, words_of

LEAST = 10
LONGEST = 3
TOP = 2000
#: A candidate goes if a longer one around it has this share of its count, in percent.
ABSORBED = 50
SIDE = 256
TILES = 64
HEAD = 65_536
#: Bits of the tables of frequent words and of frequent phrases.
BITS = 1 << 24
#: Pairs held before they are counted or sorted.
HELD = 1 << 20
#: Shares of a language whose best phrases are found apart.
SHARES = 16
#: Words of the broadcast table of frequent words have at most so many characters.
SHORT = 64

# What ends a piece, and what separates words inside one.
STOPS = np.isin(np.arange(256), [*b".,;:!?", *range(0x0A, 0x0E)])
INSIDE = ~(STOPS | np.isin(np.arange(256), [0x20, 0x09]))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


@dataclass
class Tokens:
    """Words of a chunk: symbol of each, and whether the next one follows in its piece."""

    symbol: np.ndarray
    follows: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray


def tokens_of(chunk: Chunk, languages: np.ndarray) -> Tokens:
    """``languages``: a 64-bit hash per row."""
    words = words_of(chunk, INSIDE)
    symbol = mix(words.hash + mix(languages)[words.row])
    stops = np.cumsum(STOPS[chunk.data], dtype=np.int64)[words.start]
    follows = np.zeros(len(symbol), bool)
    follows[:-1] = (words.row[1:] == words.row[:-1]) & (stops[1:] == stops[:-1])
    return Tokens(symbol, follows, words.start, words.end, words.row)


def joint(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """One hash of two symbols."""
    return mix(left * np.uint64(0x9E3779B97F4A7C15) ^ mix(right))


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, symbol, n) over all rows of (text, lang, lang_hash); counted per chunk first."""

    def count(batches):
        for batch in batches:
            languages = batch.column(2).to_numpy().view(np.uint64)
            for chunk in text_chunks(batch.column(0), 8 << 20):
                t = tokens_of(chunk, languages[chunk.first : chunk.last])
                symbol, first, n = np.unique(t.symbol, return_index=True, return_counts=True)
                lang = batch.column(1).take(pa.array(chunk.first + t.row[first]))
                words = span_texts(chunk.data, t.start[first], t.end[first])
                yield pa.RecordBatch.from_arrays(
                    [lang, words, _signed(symbol), pa.array(n.astype(np.int64))], names=["lang", "word", "symbol", "n"]
                )

    parts = docs.mapInArrow(count, "lang string, word string, symbol long, n long")
    return parts.groupBy("lang", "word", "symbol").agg(F.sum("n").alias("n"))


def bit_table(spark: SparkSession, hashes: DataFrame, bits: int) -> np.ndarray:
    """64-bit words of a table in which the bit of every hash is set; the driver gets ``bits`` / 64 rows at most."""
    slot = F.pmod("hash", F.lit(bits))
    rows = hashes.select(F.shiftright(slot, 6).cast("int").alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int")).alias("bit"))
    found = rows.groupBy("at").agg(F.bit_or("bit").alias("bit")).toArrow()
    table = np.zeros(bits // 64, np.uint64)
    table[found.column("at").to_numpy()] = found.column("bit").to_numpy().view(np.uint64)
    return table


def marked(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes & np.uint64(64 * len(table) - 1)  # the remainder, as ``pmod`` has it
    return (table[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


@dataclass
class Ranks:
    """The first ranks of symbols: sorted hashes, the parts of each, its block and place in it."""

    hashes: np.ndarray
    parts: tuple[np.ndarray, ...]
    block: np.ndarray
    place: np.ndarray
    #: (language, number of its words, sum of counts) of each block.
    blocks: list[tuple[str, int, int]] = field(default_factory=list)

    def find(self, hashes: np.ndarray, parts: tuple[np.ndarray, ...]) -> np.ndarray:
        """Index of each symbol, -1 if it has no rank here; equal parts, not hashes, decide."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        same = self.hashes[at] == hashes
        for own, part in zip(self.parts, parts, strict=True):
            same &= own[at] == part
        return np.where(same, at, -1)


def ranked(lang: list[str], n: np.ndarray, hashes: np.ndarray, parts: tuple[np.ndarray, ...], totals: dict[str, int]) -> Ranks:
    """Ranks by falling count, language by language, cut into blocks of ``SIDE``."""
    names, which = np.unique(np.array(lang, object), return_inverse=True) if lang else ([], np.zeros(0, np.int64))
    block, place = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
    blocks: list[tuple[str, int, int]] = []
    for j, name in enumerate(names):
        own = np.flatnonzero(which == j)
        own = own[np.lexsort((hashes[own], -n[own]))]
        rank = np.arange(len(own))
        block[own], place[own] = len(blocks) + rank // SIDE, rank % SIDE
        blocks += [(name, totals[name], int(n[own[a : a + SIDE]].sum())) for a in range(0, len(own), SIDE)]
    order = np.argsort(hashes, kind="stable")
    return Ranks(hashes[order], tuple(p[order] for p in parts), block[order], place[order], blocks)


def dense_tiles(left: Ranks, right: Ranks, tiles: int = TILES) -> dict[tuple[int, int], int]:
    """The tiles with the most expected pairs: (left block, right block) -> number."""
    others: dict[str, list[tuple[int, int]]] = {}
    for j, (lang, _, mass) in enumerate(right.blocks):
        others.setdefault(lang, []).append((j, mass))
    expected = [
        (-mass * other / max(1, total), i, j)
        for i, (lang, total, mass) in enumerate(left.blocks)
        for j, other in others.get(lang, ())
    ]
    return {(i, j): k for k, (_, i, j) in enumerate(heapq.nsmallest(tiles, expected))}


class Counter:
    """Counts (left, right) inside a task and hands out coordinates with counts."""

    def __init__(self, left: Ranks, right: Ranks, tiles: dict[tuple[int, int], int], names: list[str]):
        self.left, self.right, self.names = left, right, names
        self.tiles = sorted(tiles, key=tiles.get)
        # Blocks that have a dense tile are numbered from 1, all others are 0.
        self.line, self.column = (np.zeros(len(r.blocks) + 1, np.int64) for r in (left, right))
        for numbers, side in ((self.line, 0), (self.column, 1)):
            for i, block in enumerate(sorted({t[side] for t in tiles})):
                numbers[block] = i + 1
        self.number = np.full((self.line.max() + 1, self.column.max() + 1), -1)
        for (i, j), k in tiles.items():
            self.number[self.line[i], self.column[j]] = k
        self.cells = np.zeros(len(tiles) * SIDE * SIDE, np.int64)
        self.dense: list[np.ndarray] = []
        self.sparse: list[tuple[np.ndarray, ...]] = []
        self.n_dense = self.n_sparse = 0

    def add(self, left_hash: np.ndarray, left: tuple[np.ndarray, ...], right: np.ndarray):
        a, b = self.left.find(left_hash, left), self.right.find(right, (right,))
        # Index -1 finds the entry behind the last block, which has no tile.
        tile = self.number[self.line[np.append(self.left.block, -1)[a]], self.column[np.append(self.right.block, -1)[b]]]
        here = tile >= 0
        cell = (tile[here] * SIDE + self.left.place[a[here]]) * SIDE + self.right.place[b[here]]
        self.dense.append(cell)
        self.n_dense += len(cell)
        self.sparse.append((*(x[~here] for x in left), right[~here]))
        self.n_sparse += int((~here).sum())
        if self.n_dense >= HELD:
            self._add_cells()
        if self.n_sparse >= HELD:
            yield from self._sorted()

    def _add_cells(self) -> None:
        if self.n_dense:
            self.cells += np.bincount(np.concatenate(self.dense), minlength=len(self.cells))
        self.dense, self.n_dense = [], 0

    def _sorted(self):
        columns = [np.concatenate(x) for x in zip(*self.sparse, strict=True)] if self.sparse else []
        self.sparse, self.n_sparse = [], 0
        if not columns or not len(columns[0]):
            return
        key = columns[0]
        for column in columns[1:]:
            key = joint(key, column)
        order = np.argsort(key)
        columns = [c[order] for c in columns]
        new = np.ones(len(order), bool)
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
        first = np.flatnonzero(new)
        yield from self._batches([c[first] for c in columns], np.diff(np.append(first, len(order))))

    def _batches(self, columns: list[np.ndarray], n: np.ndarray, size: int = 1 << 16):
        for at in range(0, len(n), size):
            part = slice(at, at + size)
            yield pa.RecordBatch.from_arrays([*(_signed(c[part]) for c in columns), pa.array(n[part].astype(np.int64))], names=self.names)

    def finish(self):
        yield from self._sorted()
        self._add_cells()
        symbols = [{}, {}]
        for side, ranks in enumerate((self.left, self.right)):
            order = np.lexsort((ranks.place, ranks.block))
            edge = np.searchsorted(ranks.block[order], np.arange(len(ranks.blocks) + 1))
            symbols[side] = {k: order[edge[k] : edge[k + 1]] for k in range(len(ranks.blocks))}
        for k, (i, j) in enumerate(self.tiles):
            grid = self.cells[k * SIDE * SIDE : (k + 1) * SIDE * SIDE]
            some = np.flatnonzero(grid)
            a, b = symbols[0][i][some // SIDE], symbols[1][j][some % SIDE]
            yield from self._batches([*(p[a] for p in self.left.parts), self.right.hashes[b]], grid[some])


def _count_phrases(docs: DataFrame, size: int, words: np.ndarray, shorter: np.ndarray | None, left: Ranks, right: Ranks) -> DataFrame:
    """(w1, .., w_size, n) of the phrases of ``size`` words that can be frequent."""
    names = [f"w{i + 1}" for i in range(size)] + ["n"]
    sent = docs.sparkSession.sparkContext.broadcast((words, shorter, left, right, dense_tiles(left, right)))

    def count(batches):
        words, shorter, left, right, tiles = sent.value
        counter = Counter(left, right, tiles, names)
        for batch in batches:
            languages = batch.column(2).to_numpy().view(np.uint64)
            for chunk in text_chunks(batch.column(0)):
                t = tokens_of(chunk, languages[chunk.first : chunk.last])
                m = len(t.symbol) - size + 1
                if m <= 0:
                    continue
                parts = [t.symbol[i : i + m] for i in range(size)]
                at = marked(words, parts[0])
                for i in range(1, size):
                    at &= t.follows[i - 1 : i - 1 + m]
                at = np.flatnonzero(at)
                for part in parts[1:]:
                    at = at[marked(words, part[at])]
                parts = [p[at] for p in parts]
                start = parts[0]
                for part in parts[1:-1]:
                    start = joint(start, part)
                if shorter is not None:
                    end = parts[1]
                    for part in parts[2:]:
                        end = joint(end, part)
                    some = marked(shorter, start) & marked(shorter, end)
                    start, parts = start[some], [p[some] for p in parts]
                yield from counter.add(start, tuple(parts[:-1]), parts[-1])
        yield from counter.finish()

    found = docs.mapInArrow(count, ", ".join(f"{c} long" for c in names))
    return found.groupBy(*names[:-1]).agg(F.sum("n").alias("n"))


def _with_hashes(phrases: DataFrame, size: int) -> DataFrame:
    """Phrases with the hash of their symbols in ``hash``."""

    def run(batches):
        for batch in batches:
            parts = [batch.column(i).to_numpy().view(np.uint64) for i in range(size)]
            key = parts[0]
            for part in parts[1:]:
                key = joint(key, part)
            yield pa.RecordBatch.from_arrays([*batch.columns, _signed(key)], names=[*batch.schema.names, "hash"])

    names = [f"w{i + 1}" for i in range(size)] + ["n", "hash"]
    return phrases.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _with_word(spark: SparkSession, phrases: DataFrame, column: str, head: DataFrame, words: DataFrame) -> DataFrame:
    """``phrases`` with (lang, word, count) of a symbol column as ``<column>_lang``, ``_word`` and ``_n``.

    The frequent words come from a broadcast table, so that no hot word is a
    join key; phrases of those spread over the join with the other words.
    """
    names = [f"{column}_{c}" for c in ("lang", "word", "n")]
    symbols = [c for c in phrases.columns if c[0] == "w" and c[1:].isdigit()]

    def named(table: DataFrame, key: str, prefix: str) -> DataFrame:
        return table.select(F.col("symbol").alias(key), *[F.col(c).alias(prefix + n) for c, n in zip(("lang", "word", "n"), names, strict=True)])

    first = phrases.join(F.broadcast(named(head, column, "_h_")), column, "left")
    known = F.col(f"_h_{names[2]}").isNotNull()
    first = first.withColumn("_key", F.when(known, F.xxhash64(*symbols)).otherwise(F.col(column)))
    both = first.join(named(words, "_key", "_r_"), "_key", "left")
    return both.select(*phrases.columns, *[F.when(known, F.col(f"_h_{n}")).otherwise(F.col(f"_r_{n}")).alias(n) for n in names])


def _scored(spark: SparkSession, phrases: DataFrame, size: int, frequent: dict[int, DataFrame], head: DataFrame, words: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of phrases of ``size`` words."""
    rows = phrases
    for i in range(size):
        rows = _with_word(spark, rows, f"w{i + 1}", head, words)
    cuts = []
    for k in range(1, size):
        sides = []
        for first, length in ((1, k), (k + 1, size - k)):
            if length == 1:
                sides.append(f"w{first}_n")
                continue
            name = f"_n{first}_{length}"
            part = frequent[length].select(*[F.col(f"w{j + 1}").alias(f"w{first + j}") for j in range(length)], F.col("n").alias(name))
            rows = rows.join(part, [f"w{first + j}" for j in range(length)])
            sides.append(name)
        left, right = (f"cast({c} as decimal(16, 0))" for c in sides)
        square = "cast(n as decimal(16, 0)) * cast(n as decimal(16, 0)) * cast(1000000 as decimal(7, 0))"
        cuts.append(F.struct(
            F.expr(f"({square}) div ({left} * {right})").alias("score"), F.lit(k).alias("k"),
            F.col(sides[0]).alias("l"), F.col(sides[1]).alias("r"),
        ))
    best = F.array_min(F.array(*cuts))
    return rows.select(
        F.col("w1_lang").alias("lang"), F.concat_ws(" ", *[F.col(f"w{i + 1}_word") for i in range(size)]).alias("phrase"),
        F.col("n").alias("a"), best.alias("best"),
    ).select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def _kept(phrases: DataFrame, size: int, candidates: dict[int, DataFrame], absorbed: int) -> DataFrame:
    """Phrases that no longer candidate takes in."""
    around = [
        longer.select(*[F.col(f"w{first + j}").alias(f"w{j + 1}") for j in range(size)], F.col("n").alias("longest"))
        for length, longer in candidates.items() if length > size
        for first in range(1, length - size + 2)
    ]
    if not around:
        return phrases
    every = around[0]
    for more in around[1:]:
        every = every.union(more)
    keys = [f"w{j + 1}" for j in range(size)]
    every = every.groupBy(*keys).agg(F.max("longest").alias("longest"))
    free = F.col("longest").isNull() | (F.col("longest") * 100 < F.col("n") * absorbed)
    return phrases.join(every, keys, "left").where(free).select(*phrases.columns)


def collocations(
    spark: SparkSession,
    docs: DataFrame,
    *,
    text_col: str = "text",
    lang_col: str = "lang",
    least: int = LEAST,
    longest: int = LONGEST,
    top: int = TOP,
    absorbed: int = ABSORBED,
    head: int = HEAD,
    bits: int = BITS,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of 2 to ``longest`` words of each language."""
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    rows = docs.select(F.col(text_col).alias("text"), lang.alias("lang"), F.xxhash64(lang).alias("lang_hash"))
    counted = stored(spark, word_counts(rows), "phrase_words")
    totals = counted.groupBy("lang").agg(F.sum("n").alias("n"))
    words = counted.where(F.col("n") >= least)

    # Ranks of the most frequent words: a bounded number of rows.
    first = words.orderBy(F.desc("n"), "symbol").limit(head)
    told = first.select("lang", "symbol", "n").toArrow()
    of_head = totals.join(first.select("lang").distinct(), "lang").collect()
    sums = {r["lang"]: r["n"] for r in of_head}

    def column(table: pa.Table, name: str) -> np.ndarray:
        return table.column(name).to_numpy()

    symbols = column(told, "symbol").view(np.uint64)
    right = ranked(told.column("lang").to_pylist(), column(told, "n"), symbols, (symbols,), sums)
    word_bits = bit_table(spark, words.select(F.col("symbol").alias("hash")), bits)

    left, shorter = right, None
    candidates: dict[int, DataFrame] = {}
    for size in range(2, longest + 1):
        found = _count_phrases(rows, size, word_bits, shorter, left, right).where(F.col("n") >= least)
        found = stored(spark, _with_hashes(found, size), "phrases")
        candidates[size] = found.drop("hash")
        if size < longest:
            # Frequent phrases get ranks of their own: the left symbols of the next round.
            shorter = bit_table(spark, found, 2 * bits)
            best = found.orderBy(F.desc("n"), "hash").limit(head)
            best = best.join(words.select(F.col("symbol").alias("w1"), "lang"), "w1").select("lang", "hash", "n", *[f"w{i + 1}" for i in range(size)]).toArrow()
            parts = tuple(column(best, f"w{i + 1}").view(np.uint64) for i in range(size))
            left = ranked(best.column("lang").to_pylist(), column(best, "n"), column(best, "hash").view(np.uint64), parts, _sums_for(best, sums, totals))

    short = first.where((F.length("word") <= SHORT) & (F.length("lang") <= SHORT))
    out = None
    for size, phrases in candidates.items():
        part = _scored(spark, _kept(phrases, size, candidates, absorbed), size, candidates, short, words)
        out = part if out is None else out.union(part)
    # The best of each share of a language, then the best of these: SHARES * top rows a language in one task.
    order = (F.desc("score"), F.desc("a"), "phrase")
    share = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SHARES))).orderBy(*order)
    out = out.withColumn("rank", F.row_number().over(share)).where(F.col("rank") <= top)
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return out.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _sums_for(best: pa.Table, sums: dict[str, int], totals: DataFrame) -> dict[str, int]:
    """Totals of the languages of ranked phrases, read where the ranked words do not have them."""
    missing = sorted(set(best.column("lang").to_pylist()) - set(sums))
    if not missing:
        return sums
    return sums | {r["lang"]: r["n"] for r in totals.where(F.col("lang").isin(missing)).collect()}
