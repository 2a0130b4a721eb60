"""Which key changes hold, and where every key ends (M6).

A key is a place that holds one row or none.  ``audit_mapping`` checks a set of
key changes that happen at once, ``compose_moves`` a sequence of them; both
return a mapping without a clash for ``changes.rekey_rows`` and list what they
turned down.  Chains of any length are followed by pointer jumping: each round
doubles the number of steps that a pointer covers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.session import ensure_checkpoint_dir

# Reasons, as listed.
NO_ROW = "no row has old_id"
TAKEN = "new_id is taken"
TWO_NEW = "old_id has another new_id"
TWO_OLD = "new_id has another old_id"


def last_of_chains(links: DataFrame) -> DataFrame:
    """(node, last) of (node, next): ``last`` ends the chain that begins at node, null on a cycle.

    A node has one ``next`` or null.  On a cycle no pointer ever ends; its
    length is at most the number of nodes, which bounds the rounds.
    """
    ensure_checkpoint_dir(links.sparkSession)
    now = links.select("node", "next", F.col("node").alias("last")).checkpoint(eager=True)
    rounds = max(1, now.count()).bit_length() + 1
    for _ in range(rounds):
        if not now.where("next is not null").limit(1).count():
            break
        ahead = now.select(F.col("node").alias("_n"), F.col("next").alias("_next"), F.col("last").alias("_last"))
        hop = F.col("next").isNotNull()
        # Chains that have ended carry their own node, so no null key is joined.
        key = F.coalesce("next", "node")
        now = now.join(ahead, key == F.col("_n")).select(
            "node", F.when(hop, F.col("_next")).alias("next"), F.when(hop, F.col("_last")).otherwise(F.col("last")).alias("last")
        ).checkpoint(eager=True)
    return now.select("node", F.when(F.col("next").isNull(), F.col("last")).alias("last"))


def audit_mapping(keys: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((old_id, new_id) that hold when applied at once, (old_id, new_id, reason) of the others).

    Of several new ids of a key, and of several keys of a new id, the smallest
    counts.  A chain of changes holds if its end is free, a cycle (a swap) always
    does; a chain that ends at a key that stays falls whole.
    """
    keys = keys.select(F.col(keys.columns[0]).cast("bigint").alias("_key")).where("_key is not null").distinct()
    given = mapping.select(F.col("old_id").cast("bigint"), F.col("new_id").cast("bigint")).distinct().where("old_id <> new_id")
    held = keys.select(F.col("_key").alias("old_id"), F.lit(True).alias("_held"))
    by_old, by_new = Window.partitionBy("old_id"), Window.partitionBy("new_id")
    marked = given.join(held, "old_id", "left").withColumn("_first", F.min("new_id").over(by_old))
    counts = F.col("_held").isNotNull() & (F.col("new_id") == F.col("_first"))
    marked = marked.withColumn("_only", F.min(F.when(counts, F.col("old_id"))).over(by_new))
    reason = (
        F.when(F.col("_held").isNull(), NO_ROW).when(F.col("new_id") != F.col("_first"), TWO_NEW).when(F.col("old_id") != F.col("_only"), TWO_OLD)
    )
    marked = marked.select("old_id", "new_id", reason.alias("reason")).checkpoint(eager=True)
    alive = marked.where("reason is null").select("old_id", "new_id")
    # Follow each change to the next key that moves; the last one's new id must be free.
    after = alive.select(F.col("old_id").alias("new_id"), F.lit(True).alias("_moves"))
    links = alive.join(after, "new_id", "left").select(F.col("old_id").alias("node"), F.when(F.col("_moves"), F.col("new_id")).alias("next"))
    ends = last_of_chains(links)
    taken = alive.join(keys, alive.new_id == keys._key, "left_semi").select(F.col("old_id").alias("last"), F.lit(True).alias("_taken"))
    # A chain's end is the last change: taken if a row that stays holds its new id.
    blocked = ends.where("last is not null").join(taken, "last").select(F.col("node").alias("old_id"))
    good = alive.join(blocked, "old_id", "left_anti")
    bad = marked.where("reason is not null").unionByName(alive.join(blocked, "old_id", "left_semi").withColumn("reason", F.lit(TAKEN)))
    return good, bad


def compose_moves(keys: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((old_id, new_id): first and last key of every row that moves, (seq, old_id, new_id, reason) of the rejected).

    ``moves``: (seq, old_id, new_id), applied one after the other by (seq,
    old_id, new_id).  A move needs a row at ``old_id`` and none at ``new_id`` at
    its time.  Whether a move holds depends on earlier ones only; all are taken
    to hold at first, and judged again by those that held until nothing
    changes, which takes as many rounds as rejections depend on one another.
    """
    ensure_checkpoint_dir(keys.sparkSession)
    move = F.struct(F.col("seq").cast("bigint").alias("seq"), F.col("old_id").cast("bigint").alias("old_id"), F.col("new_id").cast("bigint").alias("new_id"))
    given = moves.where("old_id <> new_id").select(move.alias("move")).distinct()
    base = keys.select(F.col(keys.columns[0]).cast("bigint").alias("place"), F.lit(True).alias("_base")).where("place is not null").distinct()
    sides = given.select(
        "move", F.explode(F.array(*[F.struct(F.col(f"move.{c}").alias("place"), F.lit(c == "new_id").alias("enters")) for c in ("old_id", "new_id")])).alias("s")
    ).select("move", "s.*")
    sides = sides.join(base, "place", "left").select("move", "place", "enters", F.col("_base").isNotNull().alias("base")).checkpoint(eager=True)

    at_place = Window.partitionBy("place").orderBy("move")
    before = at_place.rowsBetween(Window.unboundedPreceding, -1)
    held = sides.withColumn("holds", F.lit(True))
    while True:
        full = F.coalesce(F.last(F.when(F.col("holds"), F.col("enters")), ignorenulls=True).over(before), F.col("base"))
        judged = held.select("move", "place", "enters", "base", F.col("holds").alias("old"), (full != F.col("enters")).alias("fits"))
        both = judged.groupBy("move").agg(F.bool_and("fits").alias("holds"))
        held = judged.join(both, "move").checkpoint(eager=True)
        if not held.where("old <> holds").limit(1).count():
            break
        held = held.select("move", "place", "enters", "base", "holds")

    lost = held.where("not enters and not holds").select("move.*", F.when(F.col("fits"), TAKEN).otherwise(NO_ROW).alias("reason"))
    real = held.where("holds")
    # At a place the moves that hold take turns: in, out, in ...
    following = F.lead("move").over(at_place)
    nexts = real.select("move", "enters", "base", following.alias("next"), F.lag("move").over(at_place).alias("earlier"))
    last = last_of_chains(nexts.where("enters").select(F.col("move").alias("node"), "next"))
    starts = nexts.where("not enters and earlier is null").select(F.col("move").alias("node"))
    paths = starts.join(last, "node").select(F.col("node.old_id").alias("old_id"), F.col("last.new_id").alias("new_id"))
    return paths.where("old_id <> new_id"), lost
