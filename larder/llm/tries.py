"""Conversation prefix trie as double arrays, one per prefix shard.

A turn is known by the MD5 of its role and text, a node by a 128-bit hash of
the turns that lead to it.  Conversations are cut into blocks of ``BLOCK``
turns; a block is a path below the node where it begins.  Equal paths are
counted once (so a third of all conversations may be copies), sorted, and cut
into shards of neighbouring paths.  Inside a task the turns of a shard get
dense ids, and its paths are packed into a double array: the child of state
``s`` by turn ``t`` is ``BASE[s] + t``, and ``CHECK`` there holds ``s``.  Walking
all paths through the array gives every node's counts, the levels of ``CHECK``
from below those of its subtree.

Only the paths at the two ends of a shard and those that go on in another block
can lie in several shards.  Their nodes, the *spine*, are merged globally: their
counts are added up, and what hangs below them is summed along the spine by
pointer doubling, in as many rounds as the logarithm of its depth.  Everything
else is final where it was packed.

A conversation may have any number of turns: positions come from a sort over
all partitions (see ``turn_positions``), a row holds ``BLOCK`` turns at most, and
the node where a block begins is a running XOR over the blocks before it.
``ends_sha256`` is one chain of SHA-256 by its definition, so the ids that end
at a node pass one task, ``PIECE`` ids a row and never held together.

Results: see ``prefix_trie``.  Turns are in the order of (turn, role, text),
null turns first; null roles and texts are empty; repeated rows are turns of
their own.  Rows without a conversation id belong to no conversation.  Long
texts are hashed where they are read and not carried on.  An empty table gives no
rows, not even a root; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.llm.common import stored

BLOCK = 32
#: Paths of one double array.
SHARD = 50_000
#: Ids of a row while the ends of nodes are hashed.
PIECE = 4096
ROOT = bytes(16)
#: Free places tried for the children of one state; beyond this they go to the end.
TRIED, MANY = 1024, 256


class DoubleArray:
    """BASE and CHECK over symbols from 1 on; state 0 is the root."""

    def __init__(self, symbols: int):
        self.symbols = symbols
        self.base = np.zeros(1, np.int64)
        self.check = np.full(1, -1, np.int64)
        self.used = np.zeros(1, bool)
        self.used[0] = True
        self.top = 1  # all places from here on are free
        self.low = 1  # all places before are used

    def _room(self, places: int) -> None:
        have = len(self.base)
        if places > have:
            more = max(places, 2 * have) - have
            self.base = np.append(self.base, np.zeros(more, np.int64))
            self.check = np.append(self.check, np.full(more, -1, np.int64))
            self.used = np.append(self.used, np.zeros(more, bool))

    def _take(self, parents: np.ndarray, places: np.ndarray) -> None:
        self.check[places] = parents
        self.used[places] = True
        self.top = max(self.top, int(places.max()) + 1)

    def add_single(self, parents: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Places of the only child of each parent: the next free ones."""
        first = self.symbols + 1
        self._room(max(first, self.top) + len(parents))
        free = first + np.flatnonzero(~self.used[first:])[: len(parents)]
        self.base[parents] = free - symbols
        self._take(parents, free)
        return free

    def add_several(self, parent: int, symbols: np.ndarray) -> np.ndarray:
        """Places of all children of a parent: the first base at which all are free."""
        least = int(symbols.min())
        steps = symbols - least
        reach = int(steps.max()) + 1
        start = max(self.top, least + 1)
        if len(symbols) <= MANY:
            while self.low < self.top and self.used[self.low]:
                self.low += 1
            begin = max(self.low, least + 1)
            self._room(self.top + 2 * TRIED + reach)
            tried = begin + np.flatnonzero(~self.used[begin : begin + 4 * TRIED])[:TRIED]
            tried = tried[tried + reach <= len(self.used)]
            fits = np.flatnonzero(~self.used[tried[:, None] + steps].any(1))
            if len(fits):
                start = int(tried[fits[0]])
        self._room(start + reach)
        self.base[parent] = start - least
        places = start + steps
        self._take(np.full(len(places), parent), places)
        return places

    def walk(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The children of states; each must exist."""
        places = self.base[states] + symbols
        if (places >= len(self.check)).any() or (self.check[places] != states).any():
            raise KeyError("no such path")
        return places


def pack(symbols: np.ndarray, offsets: np.ndarray) -> DoubleArray:
    """The double array of paths sorted so that equal prefixes are neighbours."""
    out = DoubleArray(int(symbols.max()) if len(symbols) else 0)
    size = np.diff(offsets)
    state = np.zeros(len(size), np.int64)
    for depth in range(int(size.max()) if len(size) else 0):
        rows = np.flatnonzero(size > depth)
        parent, symbol = state[rows], symbols[offsets[rows] + depth]
        new = np.ones(len(rows), bool)
        new[1:] = (parent[1:] != parent[:-1]) | (symbol[1:] != symbol[:-1])
        first = np.flatnonzero(new)
        above, by = parent[first], symbol[first]
        family = np.ones(len(first), bool)
        family[1:] = above[1:] != above[:-1]
        begin = np.flatnonzero(family)
        children = np.diff(np.append(begin, len(first)))
        places = np.empty(len(first), np.int64)
        for a, n in zip(begin[children > 1].tolist(), children[children > 1].tolist(), strict=True):
            places[a : a + n] = out.add_several(int(above[a]), by[a : a + n])
        single = begin[children == 1]
        if len(single):
            places[single] = out.add_single(above[single], by[single])
        state[rows] = places[np.cumsum(new) - 1]
    return out


def _key(start: bytes, path: bytes) -> bytes:
    return hashlib.md5(start + path).digest()


_NODES = (
    "key binary, depth long, parent binary, conv_id long, parent_conv_id long, chars long, n_convs long, "
    "n_children long, n_leaves long, saved long, spine boolean"
)


def _shard_nodes(rows: dict[str, list]) -> pa.RecordBatch:
    """The nodes of sorted paths: (block, start, path, chars, n, conv_id, goes_on, end)."""
    starts, paths = rows["start"], rows["path"]
    n_rows = len(paths)
    turns, turn_of = np.unique(np.frombuffer(b"".join(paths), "S16"), return_inverse=True)
    roots, root_of = np.unique(np.array(starts, "S16"), return_inverse=True)
    # Dense ids, the most frequent turns first, behind those of the layers' roots.
    order = np.argsort(-np.bincount(turn_of, minlength=len(turns)), kind="stable")
    dense = np.empty(len(turns), np.int64)
    dense[order] = 1 + len(roots) + np.arange(len(turns))
    size = np.array([len(p) // 16 for p in paths], np.int64) + 1
    offsets = np.concatenate(([0], np.cumsum(size)))
    symbols = np.empty(int(offsets[-1]), np.int64)
    head = np.zeros(len(symbols), bool)
    head[offsets[:-1]] = True
    symbols[head], symbols[~head] = 1 + root_of, dense[turn_of]
    chars = np.zeros(len(symbols), np.int64)
    chars[~head] = np.fromiter((c for x in rows["chars"] for c in x), np.int64, int((~head).sum()))
    trie = pack(symbols, offsets)

    # Walk all paths; what a node is told by its first path, and counts by all.
    places = len(trie.check)
    weight, conv = np.array(rows["n"], np.int64), np.array(rows["conv_id"], np.int64)
    goes_on = np.array(rows["goes_on"], bool)
    on_spine = goes_on.copy()
    on_spine[[0, -1]] = True
    layer = np.array(rows["block"], np.int64)
    n, least = np.zeros(places, np.int64), np.full(places, np.iinfo(np.int64).max)
    length, depth = np.zeros(places, np.int64), np.zeros(places, np.int64)
    spine, open_end = np.zeros(places, bool), np.zeros(places, bool)
    keys: dict[int, bytes] = {}
    state = np.zeros(n_rows, np.int64)
    levels: list[np.ndarray] = []
    for d in range(int(size.max())):
        at = np.flatnonzero(size > d)
        here = trie.walk(state[at], symbols[offsets[at] + d])
        state[at] = here
        nodes, first = np.unique(here, return_index=True)
        levels.append(nodes)
        np.minimum.at(least, here, conv[at])
        n += np.bincount(here, weight[at], places).astype(np.int64)
        length[nodes] = chars[offsets[at[first]] + d]
        depth[nodes] = layer[at[first]] * BLOCK + d
        spine[here[on_spine[at]]] = True
        for node, row in zip(nodes.tolist(), at[first].tolist(), strict=True):
            keys[node] = starts[row] if d == 0 else rows["end"][row] if d == BLOCK else _key(starts[row], paths[row][: 16 * d])
    open_end[state[goes_on]] = True

    # From below: what is not on the spine hands its sums to its parent.
    children, leaves, saved = (np.zeros(places, np.int64) for _ in range(3))
    for nodes in reversed(levels):
        own = nodes[~spine[nodes]]
        leaves[own] += children[own] == 0
        saved[own] += (n[own] - 1) * length[own]
        above = trie.check[own]
        np.add.at(children, above, 1)
        np.add.at(leaves, above, leaves[own])
        np.add.at(saved, above, saved[own])
    every = np.concatenate(levels)
    top = np.arange(len(every)) < len(levels[0])
    above = trie.check[every]
    inner = ~top
    known = inner & ~spine[above]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([keys[x] for x in every.tolist()], pa.binary()), pa.array(depth[every]),
            pa.array([keys[x] if ok else None for x, ok in zip(above.tolist(), inner.tolist(), strict=True)], pa.binary()),
            # A layer's root is counted where it ends a path, so here it counts nothing.
            pa.array(least[every], mask=top), pa.array(least[above], mask=~known), pa.array(np.where(top, 0, length[every])),
            pa.array(np.where(top, 0, n[every])), pa.array(children[every]), pa.array(leaves[every]), pa.array(saved[every]),
            pa.array(spine[every] | top),
        ],
        names=[x.split()[0] for x in _NODES.split(", ")],
    )


def pack_shards(paths: DataFrame, shard: int = SHARD) -> DataFrame:
    """The nodes of all shards; those with ``spine`` are to be merged by key."""
    at = ["block", "start", "path"]
    names = [*at, "chars", "n", "conv_id", "goes_on", "end"]

    def run(batches: Iterator[pa.RecordBatch]):
        held: dict[str, list] = {name: [] for name in names}
        for batch in batches:
            for first in range(0, batch.num_rows, shard):
                part = batch.slice(first, shard)
                for name in names:
                    held[name] += part.column(name).to_pylist()
                if len(held["path"]) >= shard:
                    yield _shard_nodes(held)
                    held = {name: [] for name in names}
        if held["path"]:
            yield _shard_nodes(held)

    return paths.select(*names).repartitionByRange(*at).sortWithinPartitions(*at).mapInArrow(run, _NODES)


def turn_positions(spark: SparkSession, convs: DataFrame, *, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv_id, position, turn_hash, chars, n_turns) of every row with a conversation id.

    Rows are sorted over all partitions; a row's place in its partition is
    corrected where a conversation began in an earlier one.
    """
    rows = convs.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"),
        F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"),
    ).where("conv_id is not null")
    # Bounded keys in the order of (role, text): its ties stay in one partition, but
    # rows that are alike and short may be parted by their number.
    brief = F.length("role") <= 64
    keys = [
        F.col("conv_id"), F.col("turn").asc_nulls_first(), F.left("role", F.lit(64)),
        F.when(brief, F.left("text", F.lit(64))).asc_nulls_last(),
        F.when(brief & (F.length("text") <= 64), F.monotonically_increasing_id()).asc_nulls_last(),
    ]
    rows = rows.repartitionByRange(*keys).sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    told = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
    rows = rows.select(
        "conv_id", F.unhex(F.md5(told.cast("binary"))).alias("turn_hash"), F.length("text").cast("long").alias("chars"),
        F.monotonically_increasing_id().alias("place"),
    )

    def count(batches):
        conv, seen = None, 0
        for batch in batches:
            ids = batch.column(0).to_numpy()
            if not len(ids):
                continue
            new = np.ones(len(ids), bool)
            new[1:] = ids[1:] != ids[:-1]
            first = np.flatnonzero(new)
            at = np.arange(len(ids)) - np.repeat(first, np.diff(np.append(first, len(ids)))) + 1
            if ids[0] == conv:
                at[: first[1] if len(first) > 1 else len(ids)] += seen
            conv, seen = ids[-1], int(at[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(batch.column(3).to_numpy() >> 33), pa.array(at)],
                                             names=["conv_id", "turn_hash", "chars", "piece", "at"])

    rows = stored(spark, rows.mapInArrow(count, "conv_id long, turn_hash binary, chars long, piece long, at long"), "trie_turns")
    whole = Window.partitionBy("conv_id")
    pieces = rows.groupBy("conv_id", "piece").agg(F.max("at").alias("size"))
    before = F.sum("size").over(whole.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1))
    pieces = pieces.select("conv_id", "piece", F.coalesce(before, F.lit(0)).alias("offset"), F.sum("size").over(whole).alias("n_turns"))
    return rows.join(pieces, ["conv_id", "piece"]).select("conv_id", (F.col("at") + F.col("offset")).alias("position"), "turn_hash", "chars", "n_turns")


def _binary(a: Column, b: Column) -> Column:
    """Two longs as 16 bytes."""
    return F.unhex(F.concat(*[F.lpad(F.hex(x), 16, "0") for x in (a, b)]))


def conversation_blocks(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """(conv_id, block, start, path, chars, is_last, end) of (conv_id, depth, turn_hash, chars, length)."""
    block = F.floor((F.col("depth") - 1) / BLOCK)
    rows = turns.groupBy("conv_id", "length", block.alias("block")).agg(F.sort_array(F.collect_list(F.struct("depth", "turn_hash", "chars"))).alias("said"))
    path = F.aggregate("said.turn_hash", F.unhex(F.lit("")), lambda a, x: F.concat(a, x))
    rows = stored(spark, rows.select("conv_id", "block", "length", path.alias("path"), F.col("said.chars").alias("chars")), "trie_blocks")
    hashes = [F.xxhash64("block", "path"), F.xxhash64(F.lit(1), "path", "block")]
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # Only conversations of several blocks need those before.
    short = rows.where(F.col("length") <= BLOCK).select("*", F.lit(0).cast("long").alias("y1"), F.lit(0).cast("long").alias("y2"))
    long = rows.where(F.col("length") > BLOCK).select(
        "*", *[F.coalesce(F.bit_xor(h).over(earlier), F.lit(0)).alias(f"y{i + 1}") for i, h in enumerate(hashes)]
    )
    rows = short.union(long)
    start = F.when(F.col("block") == 0, F.lit(ROOT)).otherwise(_binary(F.col("y1"), F.col("y2")))
    after = _binary(*[F.col(f"y{i + 1}").bitwiseXOR(h) for i, h in enumerate(hashes)])
    full = F.size("chars") == BLOCK
    rows = rows.withColumn("start", start)
    return rows.select(
        "conv_id", "block", "start", "path", "chars", (F.col("length") <= (F.col("block") + 1) * BLOCK).alias("is_last"),
        F.when(full, after).otherwise(F.unhex(F.md5(F.concat("start", "path")))).alias("end"),
    )


def end_digests(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256) of (end, conv_id): the comma-joined ids of each node, in order."""

    def join(batches):
        for batch in batches:
            keys, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out: list[tuple[bytes, int, str]] = []
            at = 0
            while at < len(keys):
                stop = at + 1
                while stop < len(keys) and keys[stop] == keys[at] and stop - at < PIECE:
                    stop += 1
                out.append((keys[at], ids[at], ",".join(map(str, ids[at:stop]))))
                at = stop
            columns = list(zip(*out, strict=True)) if out else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], names=["key", "least", "ids"])

    pieces = ends.repartitionByRange("end", "conv_id").sortWithinPartitions("end", "conv_id").select("end", "conv_id").mapInArrow(join, "key binary, least long, ids string")

    def chain(batches):
        key, state = None, None
        for batch in batches:
            out = []
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if k == key:
                    state.update(b"," + ids.encode())
                    continue
                if state is not None:
                    out.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256(ids.encode())
            yield _digests(out)
        if state is not None:
            yield _digests([(key, state.hexdigest())])

    return pieces.repartition("key").sortWithinPartitions("key", "least").mapInArrow(chain, "key binary, ends_sha256 string")


def _digests(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.binary()), pa.array([d for _, d in rows], pa.string())], names=["key", "ends_sha256"])


def merge_spine(spark: SparkSession, spine: DataFrame) -> DataFrame:
    """(key, depth, parent, conv_id, n_convs, n_children, n_leaves, saved) of the nodes on the spine, each once."""
    merged = spine.groupBy("key").agg(
        F.max("depth").alias("depth"), F.max("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.max("chars").alias("chars"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")],
    )
    merged = stored(spark, merged, "trie_spine")
    inner = merged.groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("more")).where("key is not null")
    merged = merged.join(inner, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0)))
    own = (F.col("n_children") == 0).cast("long")
    sums = stored(
        spark,
        merged.select(
            "key", "depth", "parent", "conv_id", "n_convs", "n_children", F.col("parent").alias("up"),
            (F.col("n_leaves") + own).alias("n_leaves"), (F.col("saved") + (F.col("n_convs") - 1) * F.col("chars")).alias("saved"),
        ),
        "trie_sums",
    )
    # After round i a node holds the sums of all within 2^i steps below it.
    while sums.where("up is not null").limit(1).count():
        below = sums.where("up is not null").groupBy(F.col("up").alias("key")).agg(F.sum("n_leaves").alias("l"), F.sum("saved").alias("s"))
        jump = sums.select(F.col("key").alias("up"), F.col("up").alias("next"))
        sums = stored(
            spark,
            sums.join(below, "key", "left").join(jump, "up", "left").select(
                "key", "depth", "parent", "conv_id", "n_convs", "n_children", F.col("next").alias("up"),
                (F.col("n_leaves") + F.coalesce("l", F.lit(0))).alias("n_leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"),
            ),
            "trie_sums",
        )
    return sums.drop("up")


def trie_nodes(spark: SparkSession, turns: DataFrame, convs: DataFrame, shard: int = SHARD) -> DataFrame:
    """The nodes of the trie over sequences of turns.

    ``turns``: (conv_id, depth, turn_hash, chars, length), depths from 1 to
    length; ``convs``: (conv_id, length), sequences of length 0 too.
    """
    blocks = stored(spark, conversation_blocks(spark, turns), "trie_paths")
    paths = blocks.groupBy("block", "start", "path").agg(
        F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"), F.bool_or(~F.col("is_last")).alias("goes_on"),
        F.first("chars").alias("chars"), F.first("end").alias("end"),
    )
    nodes = stored(spark, pack_shards(paths, shard), "trie_nodes")
    every = convs.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    zero = F.lit(0).cast("long")
    root = every.select(
        F.lit(ROOT).alias("key"), zero.alias("depth"), F.lit(None).cast("binary").alias("parent"), "conv_id",
        F.lit(None).cast("long").alias("parent_conv_id"), zero.alias("chars"), "n_convs",
        *[zero.alias(c) for c in ("n_children", "n_leaves", "saved")], F.lit(True).alias("spine"),
    )
    spine = merge_spine(spark, nodes.where("spine").unionByName(root))
    kept = ["key", "depth", "parent", "conv_id", "n_convs", "n_children", "n_leaves", "saved"]
    both = nodes.where("not spine").select(*kept, "parent_conv_id").unionByName(spine.select(*kept, F.lit(None).cast("long").alias("parent_conv_id")))
    above = spine.select(F.col("key").alias("parent"), F.col("conv_id").alias("above"))
    ends = blocks.where("is_last").select("end", "conv_id").union(convs.where("length = 0").select(F.lit(ROOT), "conv_id"))
    both = both.join(above, "parent", "left").join(end_digests(ends), "key", "left")
    return both.select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "above").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def prefix_trie(
    spark: SparkSession,
    convs: DataFrame,
    *,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    shard: int = SHARD,
) -> DataFrame:
    """The trie over the conversations as they are: a row per node."""
    turns = stored(spark, turn_positions(spark, convs, conv_col=conv_col, turn_col=turn_col, role_col=role_col, text_col=text_col), "trie_positions")
    sizes = turns.where("position = 1").select("conv_id", F.col("n_turns").alias("length"))
    said = turns.select("conv_id", F.col("position").alias("depth"), "turn_hash", "chars", F.col("n_turns").alias("length"))
    return trie_nodes(spark, said, sizes, shard)


def rebuilt_trie(spark: SparkSession, convs: DataFrame, *, shard: int = SHARD, group: int = 100, most: int = 6) -> DataFrame:
    """The registered query: the trie over rebuilt conversations.

    Conversation c begins with the first crc32(c) % ``most`` turns of
    conversation c - c % ``group``, then come its own turns after as many.
    """
    turns = stored(spark, turn_positions(spark, convs, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text"), "trie_positions")
    base, taken = F.col("conv_id") - F.col("conv_id") % group, F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    sizes = turns.where("position = 1").select("conv_id", "n_turns", base.alias("base"), taken.alias("h"))
    bases = sizes.where("conv_id = base").select("base", F.col("n_turns").alias("n_base"))
    plan = sizes.join(bases, "base", "left").withColumn("head", F.least("h", F.coalesce("n_base", F.lit(0))))
    plan = stored(spark, plan.withColumn("length", F.col("head") + F.greatest(F.col("n_turns") - F.col("h"), F.lit(0))), "trie_plan")
    heads = turns.where((F.col("conv_id") == base) & (F.col("position") < most)).select(
        F.col("conv_id").alias("base"), F.col("position").alias("depth"), "turn_hash", "chars"
    )
    first = plan.where("head > 0").join(heads, "base").where("depth <= head").select("conv_id", "depth", "turn_hash", "chars", "length")
    own = turns.where(F.col("position") > taken).join(plan.select("conv_id", "h", "head", "length"), "conv_id")
    rest = own.select("conv_id", (F.col("head") + F.col("position") - F.col("h")).alias("depth"), "turn_hash", "chars", "length")
    return trie_nodes(spark, first.union(rest), plan.select("conv_id", "length"), shard)
