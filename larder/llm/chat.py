"""Chat formatting after cumulative-snapshot collapse.

Logs often hold a conversation many times, each time with a few turns more.
A turn's *prefix hash* identifies the first ``i`` turns of its conversation:
the running XOR of 64-bit hashes of (position, role, text), two of them for
128 bits.  A conversation whose last prefix hash occurs inside a longer
conversation is a ``prefix`` of it and goes (anti-join); of equal
conversations the one with the smallest id is ``kept`` and the others are
``copy``.  Kept conversations are rendered.

A conversation may hold any number of turns, whatever their numbers: distinct
turns are sorted over all partitions, a turn's position is its place in its
partition behind the turns of its conversation in the partitions before, and
blocks are cut every ``BLOCK`` positions.  Their hashes are chained by a second,
small window; a block is rendered as one part.

Results.  Turns are ordered by (turn, role, text), nulls first, but null turn
numbers last; repeated rows count once.  Null roles and texts differ from
every other value and are rendered as ``unknown`` and an empty text.  Turns
with a null conversation id form one conversation whose id is null, the last
in any order.  Markup in a text cannot end its turn: the markers are broken.
An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.llm.common import stored

BLOCK = 1024

# Fixed values of the rendered format.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def turn_hashes(spark: SparkSession, convs: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, block: int = BLOCK) -> DataFrame:
    """(conv_id, key, block, role, text, position, n_turns, h1, h2) of each distinct turn.

    ``h1`` and ``h2`` identify the conversation's first ``position`` turns.
    """
    conv = F.col(conv_col)
    rows = convs.select(
        conv.alias("conv_id"),
        F.when(conv.isNull(), "null").otherwise(F.concat(F.lit("c"), conv.cast("string"))).alias("key"),
        F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"),
    ).dropDuplicates(["key", "turn", "role", "text"])
    order = [F.col("key"), F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()]
    # ``place`` rises in this order: the partition's number, then the place in it.
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    rows = stored(spark, rows, "sorted_turns").withColumn("piece", F.shiftright("place", 33))
    # Sizes of a conversation's pieces: one row for each partition that holds some of it.
    by_conv = Window.partitionBy("key")
    pieces = rows.groupBy("key", "piece").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("size"))
    before = by_conv.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(
        "key", "piece", "first",
        F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"),
        F.sum("size").over(by_conv).alias("n_turns"),
    )
    rows = rows.join(pieces, ["key", "piece"]).withColumn("position", F.col("place") - F.col("first") + F.col("offset") + 1)
    rows = rows.withColumn("block", F.floor((F.col("position") - 1) / block))
    inside = Window.partitionBy("key", "block").orderBy("position")
    earlier = by_conv.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)

    def value(c):
        return F.coalesce(F.concat(F.lit("v"), F.col(c)), F.lit("n"))

    term1 = F.xxhash64("position", value("role"), value("text"))
    term2 = F.xxhash64(F.lit(1), value("text"), "position", value("role"))
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("x1", F.bit_xor(term1).over(running)).withColumn("x2", F.bit_xor(term2).over(running))
    ends = rows.groupBy("key", "block").agg(F.max(F.struct("position", "x1", "x2")).alias("e"))
    ends = ends.select(
        "key", "block",
        F.coalesce(F.bit_xor("e.x1").over(earlier), F.lit(0)).alias("y1"),
        F.coalesce(F.bit_xor("e.x2").over(earlier), F.lit(0)).alias("y2"),
    )
    return rows.join(ends, ["key", "block"]).select(
        "conv_id", "key", "block", "role", "text", "position", "n_turns",
        F.col("x1").bitwiseXOR(F.col("y1")).alias("h1"), F.col("x2").bitwiseXOR(F.col("y2")).alias("h2"),
    )


def collapse(turns: DataFrame) -> DataFrame:
    """(conv_id, key, n_turns, status, kept_in) of each conversation of ``turn_hashes``.

    ``kept_in``: the equal kept conversation of a copy, or the smallest id
    among the conversations that go on from a prefix; null for kept ones.
    """
    at = ["position", "h1", "h2"]
    last = turns.where("position = n_turns").select("conv_id", "key", *at)
    inner = turns.where("position < n_turns")
    # Ids of any type, null last: the smallest of (is null, id).
    smallest = F.min(F.struct(F.col("conv_id").isNull().alias("no"), "conv_id"))
    longer = inner.groupBy(*at).agg(smallest.alias("longer"))
    equal = last.groupBy(*at).agg(smallest.alias("first"))
    # Maximal conversations are those whose end lies in no longer one.
    maximal = equal.join(longer, at, "left_anti").withColumn("longer", F.lit(None).cast(longer.schema["longer"].dataType))
    others = equal.join(longer, at)
    groups = maximal.unionByName(others)
    is_first = F.col("conv_id").eqNullSafe(F.col("first.conv_id"))
    gone = F.col("longer").isNotNull()
    status = F.when(gone, "prefix").when(is_first, "kept").otherwise("copy")
    return last.join(groups, at).select(
        "conv_id", "key", F.col("position").alias("n_turns"), status.alias("status"),
        F.when(gone, F.col("longer.conv_id")).when(~is_first, F.col("first.conv_id")).alias("kept_in"),
    )


def render(turns: DataFrame, kept: DataFrame) -> DataFrame:
    """(key, part, text) of the (key, part) in ``kept``; a part is one block."""
    text = F.coalesce("text", F.lit(""))
    for marker in (OPEN, CLOSE):
        text = F.replace(text, F.lit(marker), F.lit(marker[:1] + " " + marker[1:]))
    one = F.concat(F.lit(OPEN), F.coalesce("role", F.lit("unknown")), F.lit("\n"), text, F.lit(CLOSE), F.lit("\n"))
    rows = turns.withColumnRenamed("block", "part").join(kept, ["key", "part"], "left_semi").select("key", "part", "position", one.alias("one"))
    parts = rows.groupBy("key", "part").agg(F.array_sort(F.collect_list(F.struct("position", "one"))).alias("all"))
    return parts.select("key", "part", F.array_join(F.col("all.one"), "").alias("text"))


def format_chats(
    spark: SparkSession,
    convs: DataFrame,
    *,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    block: int = BLOCK,
) -> DataFrame:
    """(conv_id, n_turns, status, kept_in, part, text): kept conversations with
    their rendered parts, the others with null part and text."""
    turns = stored(spark, turn_hashes(spark, convs, conv_col, turn_col, role_col, text_col, block), "turns")
    told = stored(spark, collapse(turns), "chats")
    numbers = F.when(F.col("status") == "kept", F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_turns") - 1) / block)))
    told = told.select("*", F.explode_outer(numbers).alias("part"))
    parts = render(turns, told.where("part is not null").select("key", "part"))
    return told.join(parts, ["key", "part"], "left").select("conv_id", "n_turns", "status", "kept_in", "part", "text")
