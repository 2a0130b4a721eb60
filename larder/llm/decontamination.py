"""Benchmark decontamination with one Aho-Corasick automaton over words.

Items (questions, answers) are normalised to words: A-Z lower-cased, maximal
runs of digits, a-z and non-ASCII characters.  Every run of ``window``
consecutive item words is one pattern; a shorter item that has words is one
pattern as a whole.  The patterns of all items form a single automaton whose
symbols are word numbers of the benchmark vocabulary, so each document is
normalised and scanned exactly once, whatever the number of items.  Word
positions map back to character offsets of the original text.

The automaton is the one thing that every task holds.  Its size is checked
first: a benchmark of more than ``AUTOMATON`` windows is cut, item by item, into
parts with an automaton each.  The documents are then written once with a row
number and scanned by part after part; ranges and items are united by row.  (A
caller may ask for an error instead, with ``max_patterns``.)

Defined results: a null or empty text, or one without words, has 0 words, 0
hits, no items and is not contaminated; items without words match nothing;
repeated documents are judged one by one; repeated item ids are named once;
null item ids take part in hits but cannot be named.  An empty benchmark
contaminates nothing.  Other columns of the input, whatever their names, pass
through untouched.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm.common import columns, extended, free_names, stored, tidy, with_fields

WINDOW = 13
#: A document is contaminated if one word in so many is hit.
SHARE = 20
#: Windows of one automaton.
AUTOMATON = 1_000_000

# Fixed value: the word pattern of the contract, on lower-cased text.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
# The same words in the text as written (capitals count as letters).
WORD_AS_WRITTEN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_UPPER = {c: c + 32 for c in range(65, 91)}
#: Byte map: lower case, word bytes kept, all others a space.
_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)

SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
FIELDS = [
    ("n_words", T.LongType()),
    ("n_hit", T.LongType()),
    ("items", T.ArrayType(T.StringType())),
    ("spans", SPAN),
    ("contaminated", T.BooleanType()),
]


def item_patterns(text: str | None, window: int = WINDOW) -> list[tuple[str, ...]]:
    words = WORD.findall((text or "").translate(_UPPER))
    if not words:
        return []
    if len(words) < window:
        return [tuple(words)]
    return [tuple(words[i : i + window]) for i in range(len(words) - window + 1)]


def build(vocabulary, patterns):
    """(vocabulary, automaton, whether it holds any pattern)."""
    machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for key, items in patterns:
        machine.add_word(key, (len(key), items))
    if patterns:
        machine.make_automaton()
    return vocabulary, machine, bool(patterns)


def windows_in(benchmark: DataFrame, text_col: str, window: int) -> int:
    """How many windows the items have, counted on the cluster."""
    words = F.size(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"(?s)([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"), F.lit(1)))
    return benchmark.agg(F.sum(F.greatest(F.lit(1), words - window + 1)).alias("n")).first()["n"] or 0


def load_patterns(benchmark: DataFrame, id_col: str, text_col: str, window: int):
    """(vocabulary, patterns) of one automaton, on the driver."""
    names: dict[tuple[str, ...], set] = {}
    for row in benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).collect():
        for key in item_patterns(row["t"], window):
            names.setdefault(key, set()).update([row["i"]] if row["i"] is not None else [])
    vocabulary: dict[bytes, int] = {}
    patterns = [
        (tuple(vocabulary.setdefault(w.encode(), len(vocabulary) + 1) for w in key), tuple(sorted(ids)))
        for key, ids in names.items()
    ]
    return vocabulary, patterns


def scan(text: str | None, vocabulary, machine, live: bool):
    """(n_words, hit word ranges merged, item names) of one text."""
    words = text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []
    if not words or not live:
        return len(words), [], set()
    get = vocabulary.get
    ranges, items = [], set()
    for last, (size, names) in machine.iter(tuple([get(w, 0) for w in words])):
        first = last - size + 1
        while ranges and ranges[-1][0] >= first:
            ranges.pop()
        if ranges and ranges[-1][1] >= first:
            ranges[-1][1] = last + 1
        else:
            ranges.append([first, last + 1])
        items.update(names)
    return len(words), ranges, items


def spans_of(text: str, ranges) -> list[dict]:
    """Word ranges as character ranges of the original text."""
    places = [m.span() for m in WORD_AS_WRITTEN.finditer(text)]
    return [{"start": places[a][0], "end": places[b - 1][1]} for a, b in ranges]


def united(ranges) -> list[list[int]]:
    """Word ranges in any order as disjoint ones."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and out[-1][1] >= a:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def decontaminate(
    spark: SparkSession,
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    share: int = SHARE,
    max_patterns: int | None = None,
    automaton: int = AUTOMATON,
) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the columns of ``FIELDS``; also returns their final names.

    ``spans`` holds character ranges of the original text covered by benchmark
    windows; ``items`` the ids of items with a window in the text, as sorted
    strings.
    """
    found = windows_in(benchmark, item_text_col, window)
    if max_patterns is not None and found > max_patterns:
        raise ValueError(f"the benchmark has {found} windows, more than max_patterns={max_patterns}")
    names = free_names(docs, *[n for n, _ in FIELDS])
    schema = with_fields(docs, list(zip(names, [t for _, t in FIELDS], strict=True)))
    at = dict(zip([n for n, _ in FIELDS], names, strict=True))
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.bool_())

    def told(text, n, ranges, items) -> tuple:
        hit = sum(b - a for a, b in ranges)
        return n, hit, sorted(items), spans_of(text, ranges) if ranges else [], hit > 0 and share * hit >= n

    def as_columns(rows: list[tuple]) -> list[pa.Array]:
        return [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]

    parts = max(1, -(-found // automaton))
    if parts == 1:
        sent = spark.sparkContext.broadcast(load_patterns(benchmark, item_id_col, item_text_col, window))

        def judge(batches):
            built = build(*sent.value)
            for batch in batches:
                texts = batch.column(text_col).to_pylist()
                yield extended(batch, names, as_columns([told(text, *scan(text, *built)) for text in texts]))

        return docs.mapInArrow(tidy(judge), schema), at

    # Several automata: a row number ties together what each of them finds.
    (number,) = free_names(docs, "row")
    rows = stored(spark, docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    part_of = F.pmod(F.xxhash64(F.col(item_id_col).cast("string"), item_text_col), F.lit(parts))
    every = None
    for i in range(parts):
        sent = spark.sparkContext.broadcast(load_patterns(benchmark.where(part_of == i), item_id_col, item_text_col, window))

        def look(batches, sent=sent):
            built = build(*sent.value)
            for batch in batches:
                seen = [scan(text, *built) for text in batch.column(1).to_pylist()]
                some = [j for j, (_, ranges, _) in enumerate(seen) if ranges]
                spans = pa.array([[{"a": a, "b": b} for a, b in seen[j][1]] for j in some], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(some, pa.int64())), spans, pa.array([sorted(seen[j][2]) for j in some], pa.list_(pa.string()))],
                    names=["hit_row", "ranges", "items"],
                )

        hits = stored(spark, rows.select(number, text_col).mapInArrow(tidy(look), "hit_row long, ranges array<struct<a:int,b:int>>, items array<string>"), "hits")
        every = hits if every is None else every.union(hits)
    # At most a row a part for each document.
    joint = every.groupBy("hit_row").agg(F.flatten(F.collect_list("ranges")).alias("_ranges"), F.flatten(F.collect_list("items")).alias("_items"))
    both = rows.join(joint, rows[number] == joint["hit_row"], "left").select(*columns(docs), "_ranges", "_items")

    def unite(batches):
        for batch in batches:
            own = batch.select(range(batch.num_columns - 2))
            out = []
            for text, ranges, items in zip(
                own.column(text_col).to_pylist(), batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True
            ):
                n = scan(text, {}, None, False)[0]
                out.append(told(text, n, united((r["a"], r["b"]) for r in ranges or []), set(items or [])))
            yield extended(own, names, as_columns(out))

    return both.mapInArrow(tidy(unite), schema), at


def contamination_digest(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's digest columns per document."""
    judged, at = decontaminate(spark, docs.select("doc_id", "text"), benchmark)
    return judged.select(
        "doc_id",
        at["n_words"],
        at["n_hit"],
        F.size(at["items"]).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", at["items"]), 256).alias("items_sha256"),
        at["contaminated"],
    )


def digest_of(items) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
