"""Conversation prefix trie: DuckDB, a plain version, tiny shards and blocks, odd input."""

import collections
import hashlib
import os
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from larder.llm import queries, tries

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, key string"


def plain(sequences):
    """The nodes of {conv_id: sequence}."""
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, seq in sequences.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ends[seq].append(c)
    children = collections.Counter(node[:-1] for node in members if node)
    leaves, saved = collections.Counter(), collections.Counter()
    for node, m in members.items():
        own = (len(m) - 1) * len(node[-1][1]) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += own
    return sorted(
        (min(m), len(v), min(members[v[:-1]]) if v else -1, len(m), children[v], leaves[v], saved[v],
         hashlib.sha256(",".join(map(str, sorted(ends[v]))).encode()).hexdigest())
        for v, m in members.items()
    )


def own_turns(rows):
    out = collections.defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            out[c].append(((turn is not None, turn or 0), role or "", text or ""))
    return {c: tuple((r, t) for _, r, t in sorted(x)) for c, x in out.items()}


def rebuilt(rows):
    own = own_turns(rows)
    out = {}
    for c, seq in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, ())[:h] + seq[h:]
    return out


def got(frame):
    assert frame.columns == COLUMNS
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in frame.collect())


def material(seed, n=260):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(1200), n):
        for turn in range(rng.randint(1, 9)):
            rows.append((c, turn, rng.choice(["user", "assistant"]), rng.choice(["", "a", "bé", "日本", "same words here"]), "k"))
    hot = [(t, "user", f"hot {t}") for t in range(7)]
    rows += [(c, *x, "k") for c in range(2000, 2200) for x in hot]  # a third of all: equal conversations
    rows += [(5000, t % 3, "user", f"t{t % 40}", "k") for t in range(150)]  # a long one with ties
    rows += [(c, t, "user", f"t{t}", "k") for c in (5100, 5103, 5205) for t in range(70 + c % 7)]
    rows += [(None, 1, "user", "nobody", "k"), (7001, None, None, None, None), (7001, 1, "user", "x", "k"), (7001, 1, "user", "x", "k"),
             (7002, None, "", "", None), (8000, 0, "r" * 80, "y" * 90, "k"), (8000, 0, "r" * 80 + "z", "a", "k"), (8000, 0, "r" * 64, "y" * 64 + "b", "k"),
             (8000, 0, "r" * 64, "y" * 64 + "a", "k"), (9000, 0, "user", "long " * 300_000, "k")]
    rng.shuffle(rows)
    return rows


@pytest.fixture(params=[(tries.SHARD, tries.BLOCK), (7, 4), (1, 2)])
def sizes(request, monkeypatch):
    monkeypatch.setattr(tries, "BLOCK", request.param[1])
    monkeypatch.setattr(tries, "PIECE", 3 if request.param[0] < 10 else tries.PIECE)
    return request.param[0]


def test_plain_version(spark, sizes):
    rows = material(2)
    convs = spark.createDataFrame(rows, SCHEMA).withColumn("Depth", F.lit("clash")).repartition(5)
    assert got(tries.rebuilt_trie(spark, convs, shard=sizes)) == plain(rebuilt(rows))


def test_conversations_as_they_are(spark):
    rows = material(3, 60)
    convs = spark.createDataFrame(rows, SCHEMA).select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("role").alias("r"), F.col("text").alias("x"))
    frame = tries.prefix_trie(spark, convs, conv_col="c", turn_col="t", role_col="r", text_col="x", shard=20)
    assert got(frame) == plain(own_turns(rows))


def test_turnless_and_empty(spark):
    # Ids whose conversations lose all their turns: the root alone, with members.
    ids = [c for c in range(1, 60) if c % 100 and zlib.crc32(str(c).encode()) % 6 >= 2][:9]
    rows = [(c, t, "user", "x", "k") for c in ids for t in range(2)]
    frame = tries.rebuilt_trie(spark, spark.createDataFrame(rows, SCHEMA))
    assert got(frame) == plain(rebuilt(rows)) and frame.count() == 1
    empty = spark.createDataFrame([], SCHEMA)
    assert tries.rebuilt_trie(spark, empty).count() == 0 and tries.prefix_trie(spark, empty, conv_col="conv_id").count() == 0
    alone = spark.createDataFrame([(None, 1, "user", "x", "k")], SCHEMA)
    assert tries.rebuilt_trie(spark, alone).count() == 0


def test_oracle(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{os.path.join(SF_SMALL, 'conversations.parquet')}')")
    res = con.execute(queries.oracle_sql()["op12_conversation_trie"])
    at = [[d[0] for d in res.description].index(c) for c in COLUMNS]
    want = sorted(tuple(-1 if r[i] is None else r[i] for i in at) for r in res.fetchall())
    assert want and got(queries.queries()["op12_conversation_trie"](spark, SF_SMALL)) == want


def test_double_array_holds_its_paths_and_no_others():
    rng = random.Random(5)
    words = sorted({tuple(rng.randint(1, 600) for _ in range(rng.randint(1, 6))) for _ in range(3000)} | {(i,) for i in range(1, 600)})
    offsets = np.concatenate(([0], np.cumsum([len(w) for w in words])))
    trie = tries.pack(np.array([s for w in words for s in w]), offsets)
    nodes = {()} | {w[:i] for w in words for i in range(1, len(w) + 1)}
    assert int((trie.check >= 0).sum()) == len(nodes) - 1
    places = set()
    for w in words:
        state = np.array([0])
        for s in w:
            state = trie.walk(state, np.array([s]))
        places.add(int(state[0]))
    assert len(places) == len(words)
    with pytest.raises(KeyError):
        trie.walk(np.array([0]), np.array([601]))
