"""Phrase collocations: DuckDB, a plain version, tiny tables and tiles, odd input."""

import collections
import os
import random
import re

import duckdb
import numpy as np
from pyspark.sql import functions as F

from conftest import SF_SMALL
from llm_fixtures import no_docs, odd_docs  # noqa: F401
from larder.llm import phrases, queries

UP = {c: c + 32 for c in range(65, 91)}
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plain(rows, least=10, longest=3, top=2000, absorbed=50):
    counts, total = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UP)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for size in range(1, longest + 1):
                counts.update((lang, tuple(w[i : i + size])) for i in range(len(w) - size + 1))
    cand = {k: n for k, n in counts.items() if len(k[1]) > 1 and n >= least}
    best = collections.Counter()
    for (lang, g), n in cand.items():
        for size in range(2, len(g)):
            for i in range(len(g) - size + 1):
                best[lang, g[i : i + size]] = max(best[lang, g[i : i + size]], n)
    out = collections.defaultdict(list)
    for (lang, g), a in cand.items():
        if (lang, g) in best and 100 * best[lang, g] >= absorbed * a:
            continue
        cuts = [(counts[lang, g[:k]], counts[lang, g[k:]]) for k in range(1, len(g))]
        score, k = min((1000000 * a * a // (x * y), k) for k, (x, y) in enumerate(cuts))
        out[lang].append((-score, -a, " ".join(g).encode(), *cuts[k]))
    return sorted(
        (lang, i + 1, g.decode(), -a, x, y, total[lang], -score)
        for lang, found in out.items() for i, (score, a, g, x, y) in enumerate(sorted(found)[:top])
    )


def got(frame):
    assert frame.columns == COLUMNS
    return sorted(map(tuple, frame.collect()))


def test_oracle(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{os.path.join(SF_SMALL, 'documents.parquet')}')")
    res = con.execute(queries.oracle_sql()["op13_phrase_collocations"])
    at = [[d[0] for d in res.description].index(c) for c in COLUMNS]
    want = sorted(tuple(r[i] for i in at) for r in res.fetchall())
    assert want and got(queries.queries()["op13_phrase_collocations"](spark, SF_SMALL)) == want


def material(seed, n=160):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "of", "a", "red", "fox", "née", "日本", "x" * 90, "it's", " z"] + [f"w{i}" for i in range(30)]
    weights = [40, 10, 30, 30, 12, 12, 8, 8, 6, 6, 4] + [2] * 30

    def text():
        out = []
        for w in rng.choices(vocabulary, weights, k=rng.randint(0, 60)):
            out.append(w + rng.choice([" ", " ", " ", " ", "\t ", ", ", ".", "\n", "!? "]))
        return "".join(out)

    return [(text(), rng.choice(["en", "en", "de", None, "und", ""])) for _ in range(n)] + [(None, "en"), ("", None), ("   ", "fr")]


def test_plain_version_with_tiny_tables(spark, monkeypatch):
    rows = material(1)
    docs = spark.createDataFrame(rows, "text string, lang string").withColumn("N", F.lit("clash")).withColumn("rank", F.lit(1)).repartition(3)
    assert got(phrases.collocations(spark, docs)) == plain(rows)
    # Tiles of 4 x 4, six ranked symbols, 64 bits, runs of 50 pairs: other paths, the same rows.
    for name, value in (("SIDE", 4), ("TILES", 3), ("HELD", 50), ("SHORT", 2)):
        monkeypatch.setattr(phrases, name, value)
    small = phrases.collocations(spark, docs, head=6, bits=64, least=4, longest=4, top=25, absorbed=70)
    assert got(small) == plain(rows, 4, 4, 25, 70)
    assert got(phrases.collocations(spark, docs, head=0, least=5)) == plain(rows, 5)


def test_odd_and_empty_tables(spark, odd_docs, no_docs):  # noqa: F811
    rows = [(r["text"], r["lang"]) for r in odd_docs.select("text", "lang").collect()]
    assert got(phrases.collocations(spark, odd_docs)) == plain(rows)
    assert got(phrases.collocations(spark, no_docs)) == []


def test_dense_cells_and_sorted_runs_count_alike():
    rng = np.random.default_rng(3)
    symbols = rng.integers(0, 1 << 63, 40).astype(np.uint64)
    n = np.arange(40, 0, -1)
    ranks = phrases.ranked(["en"] * 20 + ["de"] * 20, n, symbols, (symbols,), {"en": 900, "de": 100})
    pick = rng.integers(0, 40, (5000, 2))
    want = collections.Counter(map(tuple, symbols[pick].tolist()))
    for tiles in ({}, phrases.dense_tiles(ranks, ranks)):
        counter = phrases.Counter(ranks, ranks, tiles, ["w1", "w2", "n"])
        found = collections.Counter()
        batches = [*counter.add(symbols[pick[:, 0]], (symbols[pick[:, 0]],), symbols[pick[:, 1]]), *counter.finish()]
        for batch in batches:
            for a, b, c in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                found[a % 2**64, b % 2**64] += c
        assert found == want


def test_products_pass_64_bits(spark):
    phrase = spark.createDataFrame([(1, 2, 10**12)], "w1 long, w2 long, n long")
    words = spark.createDataFrame([("en", "a", 1, 3 * 10**12), ("en", "b", 2, 10**12)], "lang string, word string, symbol long, n long")
    row = phrases._scored(spark, phrase, 2, {}, words.limit(0), words).collect()[0]
    assert (row["score"], row["l"], row["r"]) == (333333, 3 * 10**12, 10**12)
