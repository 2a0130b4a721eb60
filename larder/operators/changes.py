"""Batch change application (M1-M6) with the model's referential effects.

Parquet tables cannot be updated in place, so every job takes the current
version of the tables plus a batch of changes and returns new DataFrames,
which the caller writes as a new version (never over the path it reads).

Change batches are DataFrames with ``op`` ('I' / 'U' / 'D'), a ``seq`` that
is unique per key and orders the changes, the key column, a ``set`` array
naming the columns an update assigns (so "set to null" differs from "leave
alone"), and the new column values.

Scale notes: updates are folded per key with ``max(struct(seq, value))``
(combined map-side, so a key updated a million times is one row per map task
before the shuffle); deletes and re-keys are anti / outer joins against the
distinct key list; Spark's byte threshold and AQE choose between a broadcast
and a shuffle join.  New IDs are dense and are assigned from per-partition
counts, never through a single-partition window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.operators.rekey import audit_mapping
from larder.schemas import PRIMARY_KEYS, SCHEMAS, children_of
from larder.session import ensure_checkpoint_dir

_LOW_BITS = (1 << 33) - 1


# --- M2: dense ID assignment -----------------------------------------------------

def dense_positions(df: DataFrame, order_cols: list[str], name: str = "_pos") -> DataFrame:
    """Add a dense 1-based position in ``order_cols`` order, fully distributed.

    1. range-partition and sort by the order columns, so partition i holds a
       contiguous, sorted slice;
    2. ``monotonically_increasing_id`` gives (partition index, row index) in
       its upper / lower bits;
    3. reliable checkpoint (to ``spark.checkpoint.dir``) pins the slices so
       the counts and the rows come from the same materialisation, and an
       executor loss re-reads instead of recomputing differently;
    4. per-partition counts -> prefix offsets (one row per partition, so the
       window and the broadcast are bounded by the partition count, not the
       data) -> position = offset + row index + 1.

    ``order_cols`` must be a total order (unique, like IDs or ``seq``): equal
    sort keys would both make positions ambiguous and keep a whole group of
    equal keys in one range partition.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    ordered = (
        df.repartitionByRange(*order_cols)
        .sortWithinPartitions(*order_cols)
        .withColumn("_mid", F.monotonically_increasing_id())
    ).checkpoint(eager=True)
    part = F.shiftright(F.col("_mid"), 33)
    counts = ordered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_part",
        F.coalesce(
            F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ).alias("_off"),
    )
    with_part = ordered.withColumn("_part", part)
    out = with_part.join(F.broadcast(offsets), "_part")
    return out.withColumn(name, F.col("_off") + F.col("_mid").bitwiseAND(F.lit(_LOW_BITS)) + 1).drop(
        "_part", "_mid", "_off"
    )


def id_floor(*frames: DataFrame, key: str):
    """Highest key over ``frames`` (0 if all empty), as a scalar subquery."""
    maxes = [f.select(F.max(key).alias("_m")) for f in frames]
    union = maxes[0]
    for m in maxes[1:]:
        union = union.unionByName(m)
    return union.select(F.coalesce(F.max("_m"), F.lit(0)).cast("bigint")).scalar()


def assign_ids(new_rows: DataFrame, base: DataFrame, key: str, order_cols: list[str], start=None) -> DataFrame:
    """M2: ``key`` = max(base key) + dense position in ``order_cols`` order
    (auto-increment semantics: an empty base starts at 1).  ``start`` overrides
    the floor, e.g. the pre-delete maximum, since deleted IDs are not reused."""
    if start is None:
        start = id_floor(base, key=key)
    positioned = dense_positions(new_rows.drop(key) if key in new_rows.columns else new_rows, order_cols)
    return positioned.withColumn(key, (start + F.col("_pos")).cast("bigint")).drop("_pos")


# --- M1: inserts --------------------------------------------------------------------

def insert_rows(base: DataFrame, new_rows: DataFrame, table: str, order_cols: list[str] | None = None,
                start=None) -> DataFrame:
    """M1: append rows; rows without IDs get auto-increment IDs (M2).

    Rows whose given ID already exists are not appended (the primary key
    would reject them); use ``pk_violations`` on the batch to report them.
    """
    key = PRIMARY_KEYS[table]
    if key not in new_rows.columns or order_cols is not None:
        new_rows = assign_ids(new_rows, base, key, order_cols or [c for c in new_rows.columns if c != key], start)
    else:
        # A key given twice enters once: the smallest row, whatever the order.
        others = [c for c in new_rows.columns if c != key]
        if others:
            new_rows = new_rows.groupBy(key).agg(F.min(F.struct(*others)).alias("_row")).select(key, "_row.*")
        else:
            new_rows = new_rows.distinct()
        keys = base.select(F.col(key).alias("_k"))
        new_rows = new_rows.join(keys, new_rows[key] == keys["_k"], "left_anti")
    return base.unionByName(_conform(new_rows, table))


def _conform(df: DataFrame, table: str) -> DataFrame:
    """Declared columns in declared order; absent columns become typed nulls."""
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in SCHEMAS[table].fields
    ])


# --- M3, M4: updates --------------------------------------------------------------------

def fold_updates(changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Per key, per column: the value of the latest (max ``seq``) update that
    sets that column.  Output: key plus ``_u_<col>`` structs (null = untouched)."""
    u = changes.where(F.col("op") == "U")
    aggs = [
        F.max(F.when(F.array_contains(F.col("set"), c), F.struct(F.col("seq"), F.col(c).alias("v")))).alias(f"_u_{c}")
        for c in columns
    ]
    return u.groupBy(key).agg(*aggs)


def update_rows(base: DataFrame, changes: DataFrame, table: str, columns: list[str] | None = None) -> DataFrame:
    """M3: apply column updates by primary key.

    A change for a key that is not in ``base`` updates nothing (not an upsert);
    a column not named in ``set`` keeps its value; a named column may be set
    to null.  Key changes are M6 (``rekey_rows``).
    """
    key = PRIMARY_KEYS[table]
    all_cols = [f.name for f in SCHEMAS[table].fields]
    columns = columns or [c for c in all_cols if c != key and c in changes.columns]
    folded = (fold_updates(changes, key, columns).withColumnRenamed(key, "_ukey"))
    joined = base.join(folded, base[key] == folded["_ukey"], "left")
    out = []
    for c in base.columns:
        if c in columns:
            u = F.col(f"_u_{c}")
            out.append(F.when(u.isNotNull(), u.getField("v")).otherwise(F.col(c)).cast(base.schema[c].dataType).alias(c))
        else:
            out.append(F.col(c))
    return joined.select(*out)


def complete_claims(claims: DataFrame, claim_ids: DataFrame, status: str = "Completed") -> DataFrame:
    """M4: set Status to ``status`` for the listed Claim_IDs."""
    ids = (claim_ids.select(F.col("Claim_ID").alias("_cid")).distinct().withColumn("_hit", F.lit(True)))
    joined = claims.join(ids, claims.Claim_ID == ids._cid, "left")
    return joined.select(
        *[F.when(F.col("_hit"), F.lit(status)).otherwise(F.col("Status")).alias("Status") if c == "Status" else F.col(c)
          for c in claims.columns]
    )


# --- M5: deletes with referential actions ------------------------------------------------

def delete_rows(tables: dict[str, DataFrame], table: str, keys: DataFrame) -> dict[str, DataFrame]:
    """M5: delete ``keys`` (one column, the table's key values) from ``table``.

    Children follow their foreign-key rule: CASCADE deletes the referencing
    rows (and recursively their own children), SET NULL clears the reference.
    Returns the new versions of every table that changed.
    """
    key = PRIMARY_KEYS[table]
    dead = (keys.select(F.col(keys.columns[0]).cast("bigint").alias("_dead")).where(F.col("_dead").isNotNull()).distinct())
    out = dict(tables)
    base = tables[table]
    out[table] = base.join(dead, base[key] == dead["_dead"], "left_anti")
    for fk in children_of(table):
        if fk.child not in out:
            continue
        child = out[fk.child]
        if fk.on_delete == "cascade" and not children_of(fk.child):
            # A leaf table: one anti join on the reference does it (rows with
            # a null reference never match and stay).
            out[fk.child] = child.join(dead, child[fk.column] == dead["_dead"], "left_anti")
        elif fk.on_delete == "cascade":
            doomed = child.join(dead, child[fk.column] == dead["_dead"], "left_semi").select(
                F.col(PRIMARY_KEYS[fk.child]).alias("_k")
            )
            out.update(delete_rows(out, fk.child, doomed))
        else:
            flag = dead.withColumn("_gone", F.lit(True))
            joined = child.join(flag, child[fk.column] == flag["_dead"], "left")
            out[fk.child] = joined.select(
                *[F.when(F.col("_gone"), F.lit(None)).otherwise(F.col(c)).cast(child.schema[c].dataType).alias(c)
                  if c == fk.column else F.col(c) for c in child.columns]
            )
    return out


# --- M6: key changes cascade ----------------------------------------------------------------

def rekey_rows(tables: dict[str, DataFrame], table: str, mapping: DataFrame) -> dict[str, DataFrame]:
    """M6: change primary keys (``mapping``: old_id, new_id) at once; references in
    child tables follow (ON UPDATE CASCADE).

    Changes that would give a key twice are left out; ``rekey.audit_mapping``
    lists them.  ``rekey.compose_moves`` makes a mapping of moves in sequence.
    """
    key = PRIMARY_KEYS[table]
    valid, _ = audit_mapping(tables[table].select(key), mapping)
    m = valid.select(F.col("old_id").alias("_old"), F.col("new_id").alias("_new"))
    out = dict(tables)

    def remap(df: DataFrame, column: str) -> DataFrame:
        joined = df.join(m, df[column] == m["_old"], "left")
        return joined.select(
            *[F.coalesce(F.col("_new"), F.col(c)).alias(c) if c == column else F.col(c) for c in df.columns]
        )

    out[table] = remap(tables[table], key)
    for fk in children_of(table):
        if fk.child in out and fk.on_update == "cascade":
            out[fk.child] = remap(out[fk.child], fk.column)
    return out


# --- combined batch ----------------------------------------------------------------------------

def first_inserts(changes: DataFrame, key: str) -> DataFrame:
    """Of each given key the first insert after the key's last delete in the batch."""
    given = changes.where((F.col("op") == "I") & F.col(key).isNotNull())
    deleted = changes.where(F.col("op") == "D").groupBy(key).agg(F.max("seq").alias("_d"))
    alive = given.join(deleted, key, "left").where(F.col("_d").isNull() | (F.col("seq") > F.col("_d")))
    start = alive.groupBy(key).agg(F.min("seq").alias("_s"))
    return alive.join(start, key).where(F.col("seq") == F.col("_s")).drop("_d", "_s")


def rejected_inserts(tables: dict[str, DataFrame], table: str, changes: DataFrame) -> DataFrame:
    """(key, seq) of the inserts after the last delete that find their key taken."""
    key = PRIMARY_KEYS[table]
    deleted = changes.where(F.col("op") == "D").groupBy(key).agg(F.max("seq").alias("_d"))
    given = changes.where((F.col("op") == "I") & F.col(key).isNotNull()).select(key, "seq").join(deleted, key, "left")
    alive = given.where(F.col("_d").isNull() | (F.col("seq") > F.col("_d")))
    held = tables[table].select(key).withColumn("_held", F.lit(True)).distinct()
    first = first_inserts(changes, key).select(key, F.col("seq").alias("_i"))
    taken = (F.col("seq") > F.col("_i")) | (F.col("_d").isNull() & F.col("_held").isNotNull())
    return alive.join(first, key).join(held, key, "left").where(taken).select(key, "seq")


def apply_changes(tables: dict[str, DataFrame], table: str, changes: DataFrame,
                  high_water: DataFrame | None = None) -> dict[str, DataFrame]:
    """Apply one batch of I, U and D changes to ``table`` in ``seq`` order.

    The changes of a key are folded first, so the batch needs one pass: a
    delete removes the row of the table and every earlier change of its key; of
    the inserts after it (or of all, if nothing is deleted) the first one
    counts, if the key is free, and only later updates change it.  Inserts
    of a key that is taken are kept out (``rejected_inserts`` lists them).
    Rows without an ID get auto-increment IDs in ``seq`` order.

    ``high_water`` (a one-column frame of earlier maxima) carries the
    auto-increment counter across versions, so IDs freed by earlier deletes
    are not handed out again.
    """
    key = PRIMARY_KEYS[table]
    inserts = changes.where(F.col("op") == "I")
    # Auto-increment never reuses IDs: the floor is taken before the deletes.
    sources = [tables[table]] + ([inserts] if key in inserts.columns else [])
    if high_water is not None:
        sources.append(high_water.select(F.col(high_water.columns[0]).cast("bigint").alias(key)))
    floor = id_floor(*sources, key=key)
    out = dict(tables)
    out[table] = update_rows(tables[table], changes, table)
    deletes = changes.where(F.col("op") == "D").select(key)
    out = delete_rows(out, table, deletes)
    cols = [f.name for f in SCHEMAS[table].fields if f.name in inserts.columns and f.name != key]
    if key in inserts.columns:
        first = first_inserts(changes, key)
        later = changes.where(F.col("op") == "U").join(first.select(key, F.col("seq").alias("_i")), key).where("seq > _i").drop("_i")
        born = update_rows(_conform(first.select(key, *cols), table), later, table)
        out[table] = insert_rows(out[table], born, table)
        inserts = inserts.where(F.col(key).isNull())
    out[table] = insert_rows(out[table], inserts.select("seq", *cols), table, order_cols=["seq"], start=floor)
    return out
