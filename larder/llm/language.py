"""Language identification by prediction by partial matching over bytes.

For every language a tree of byte contexts up to ``order`` bytes is counted on
training text.  The probability of a byte after its context follows the
longest context seen in that language; an unseen byte there costs the escape
probability d / (n + d) (n occurrences, d distinct bytes: method C) and is
looked up one byte shorter, down to a uniform choice over the alphabet.  The
statistics are frozen after training, so the code length of a text under each
language is exact and independent of the order in which texts are read.

Because nothing adapts, every (context, byte) probability is worked out once:
the contexts of all languages form one table of states (the longest suffix
seen in any language), and a scoring task adds up rows of
``bits[state, byte, language]`` over the whole text.  Bytes outside the
training alphabet share one symbol.

Training uses a bounded sample: on average ``per_language`` rows of each
language, picked by a hash of id and text, repeated rows once; byte counts are
summed by Spark.  Scoring reads every whole text.

Results: the language of the shortest code; ``score`` is its posterior under
equal priors.  A text that is null or has no letter is ``und`` with score 0.
Ties go to the alphabetically first language.  Equal texts get equal results.
Without any training row every text is ``und``.  Other columns pass through
whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm.common import held_out, extended, free_names, text_chunks, tidy, with_fields

ORDER = 3
PER_LANGUAGE = 600
MAX_LANGUAGES = 200


@dataclass
class Trees:
    """Frozen statistics of all languages.

    ``symbol`` maps bytes to alphabet numbers (0: never seen), ``state`` the
    last three symbols to a context number, ``bits`` [context * symbols +
    symbol, language] to code lengths.
    """

    languages: list[str]
    symbol: np.ndarray
    state: np.ndarray
    bits: np.ndarray

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(rows, languages) bits; contexts start anew with each row."""
        rows = len(offsets) - 1
        out = np.zeros((rows, len(self.languages)))
        if not len(data):
            return out
        a = int(self.symbol.max()) + 1
        s = self.symbol[data].astype(np.int32)
        past = []
        row_of = np.repeat(np.arange(rows, dtype=np.int32), np.diff(offsets))
        for back in (1, 2, 3):
            p = np.zeros(len(s), np.int32)
            if len(s) > back:  # nothing lies before the first byte of a row
                p[back:] = np.where(row_of[back:] == row_of[:-back], s[:-back], 0)
            past.append(p)
        state = self.state[(past[2] * a + past[1]) * a + past[0]]
        cost = self.bits[state * a + s]
        some = np.flatnonzero(np.diff(offsets))
        out[some] = np.add.reduceat(cost, offsets[:-1][some], axis=0, dtype=np.float64)
        return out


def build(grams: np.ndarray, language: np.ndarray, counts: np.ndarray, languages: list[str]) -> Trees:
    """Trees from counted four-byte grams (context of three symbols, then the byte).

    ``grams`` packs four bytes as an unsigned 32-bit number; byte 0 as context
    stands for "before the text".
    """
    n_lang = len(languages)
    parts = np.stack([grams >> np.uint32(24), grams >> np.uint32(16) & 255, grams >> np.uint32(8) & 255, grams & 255]).astype(np.int64)
    alphabet = np.unique(parts)
    alphabet = alphabet[alphabet != 0]
    symbol = np.zeros(256, np.uint8 if len(alphabet) < 255 else np.int64)
    symbol[alphabet] = np.arange(1, len(alphabet) + 1)
    a = len(alphabet) + 1
    c3, c2, c1, x = symbol[parts].astype(np.int64)
    # Probabilities, from short contexts to long ones.
    counted = [np.zeros(len(x), np.int64), c1, c2 * a + c1, (c3 * a + c2) * a + c1]
    states: list[np.ndarray] = []
    tables: list[np.ndarray] = []
    for depth in range(ORDER + 1):
        context = np.unique(counted[depth])
        at = np.searchsorted(context, counted[depth])
        n = np.zeros((len(context), a, n_lang), np.float32)
        np.add.at(n, (at, x, language), counts.astype(np.float32))
        seen = n.sum(1, keepdims=True)
        kinds = (n > 0).sum(1, keepdims=True)
        if depth == 0:
            lower = np.full((1, a, n_lang), 1.0 / a, np.float32)
        else:
            # The context without its oldest symbol.
            short = context % a ** (depth - 1)
            lower = tables[-1][np.searchsorted(states[-1], short)]
        whole = np.maximum(seen + kinds, 1)
        p = np.where(n > 0, n / whole, np.where(seen > 0, kinds / whole, 1.0) * lower)
        states.append(context)
        tables.append(p.astype(np.float32))
    # One state per context of any length; the longest known suffix wins.
    first = np.cumsum([0] + [len(s) for s in states])
    c = np.arange(a**3)
    state = np.zeros(a**3, np.int32)
    for depth in (1, 2, 3):
        suffix = c % a**depth
        at = np.minimum(np.searchsorted(states[depth], suffix), len(states[depth]) - 1)
        known = states[depth][at] == suffix
        state[known] = (first[depth] + at)[known]
    bits = -np.log2(np.concatenate(tables).reshape(-1, n_lang))
    return Trees(languages, symbol, state, bits.astype(np.float32))


def gram_counts(sample: DataFrame) -> DataFrame:
    """(lang, gram, n) summed over the sample's (lang, text)."""

    def count(batches):
        for batch in batches:
            for chunk in text_chunks(batch.column(1)):
                data, offsets = chunk.data.astype(np.uint32), chunk.offsets
                row_of = np.repeat(np.arange(chunk.rows), np.diff(offsets))
                gram = data.copy()
                for back in (1, 2, 3):
                    if len(data) > back:
                        same = row_of[back:] == row_of[:-back]
                        gram[back:] |= np.where(same, data[:-back] << np.uint32(8 * back), np.uint32(0))
                langs = batch.column(0).slice(chunk.first, chunk.rows).dictionary_encode()
                code = np.asarray(langs.indices)[row_of] if len(row_of) else np.zeros(0, int)
                key, n = np.unique(code.astype(np.int64) << 32 | gram, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [langs.dictionary.take(pa.array(key >> 32)), pa.array(key & 0xFFFFFFFF), pa.array(n.astype(np.int64))],
                    names=["lang", "gram", "n"],
                )

    counted = sample.select("lang", "text").mapInArrow(tidy(count), "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = PER_LANGUAGE,
) -> Trees:
    """Trees from rows with a language that are not held out (crc32 of the id mod 5 is not 0)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("id", 5))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    draw = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) / float(1 << 30)
    rate = F.lit(1.0)
    for lang, n in sizes.items():
        rate = F.when(F.col("lang") == lang, F.lit(min(1.0, per_language / n))).otherwise(rate)
    # The limit is twice the expected size: a guard, not a choice of rows.
    sample = rows.where(draw < rate).select("lang", "text").dropDuplicates().limit(2 * per_language * max(1, len(sizes)))
    found = gram_counts(sample).toArrow()
    languages = sorted(sizes)
    if not found.num_rows:
        return Trees([], np.zeros(256, np.uint8), np.zeros(1, np.int32), np.zeros((1, 0), np.float32))
    number = {v: i for i, v in enumerate(languages)}
    language = np.array([number[v] for v in found.column("lang").to_pylist()])
    return build(found.column("gram").to_numpy().astype(np.uint32), language, found.column("n").to_numpy(), languages)


def identify(
    spark: SparkSession, docs: DataFrame, trees: Trees, *, text_col: str = "text"
) -> tuple[DataFrame, str, str]:
    """``docs`` with (lang_pred, score) at its end; also returns their names."""
    sent = spark.sparkContext.broadcast((trees.languages, trees.symbol, trees.state, trees.bits))
    pred, score, letter = free_names(docs, "lang_pred", "score", "has_letter")
    marked = docs.withColumn(letter, F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))
    schema = with_fields(marked, [(pred, T.StringType()), (score, T.DoubleType())])

    def judge(batches):
        held = Trees(*sent.value)
        names = np.array(held.languages + ["und"], dtype=object)
        for batch in batches:
            parts = [held.code_lengths(c.data, c.offsets) for c in text_chunks(batch.column(text_col))]
            bits = np.concatenate(parts) if parts else np.zeros((0, len(held.languages)))
            if held.languages:
                best = bits.argmin(1)
                odds = np.exp2(-np.minimum(bits - bits.min(1, keepdims=True), 1000))
                sure = 1.0 / odds.sum(1)
            else:
                best, sure = np.zeros(len(bits), int), np.zeros(len(bits))
            known = np.asarray(batch.column(letter).to_pylist(), bool) & bool(held.languages)
            best = np.where(known, best, len(held.languages))
            yield extended(batch, [pred, score], [pa.array(names[best], pa.string()), pa.array(np.where(known, sure, 0.0))])

    return marked.mapInArrow(tidy(judge), schema).drop(letter), pred, score


def language_predictions(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The contract's columns for every document."""
    told, pred, score = identify(spark, docs.select("doc_id", "text"), fit(docs))
    return told.select("doc_id", held_out("doc_id", 5).alias("held_out"), F.col(pred), F.col(score))
