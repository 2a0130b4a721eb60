"""Incremental change application on hash-bucketed tables.

The copy-on-write feed (``change_feed``) rewrites whole tables per batch.  At
scale a batch of edits touches a tiny fraction of the rows, so here each table
is a catalog table partitioned by ``bucket = pmod(xxhash64(key), n)`` and a
batch rewrites only the buckets that hold an affected row:

1. inserts without an ID get theirs first (dense, above the auto-increment
   high-water mark), so every change has a key and therefore a bucket;
2. affected keys per table: the changed keys of the target, and for each
   child table the rows whose reference is deleted (a two-column scan of the
   child, joined to the deleted keys);
3. the touched buckets (at most ``n`` numbers) are read with partition
   pruning, the ordinary batch jobs of ``larder.operators.changes`` run on
   those rows, the result is checkpointed, and the buckets are overwritten
   (dynamic partition overwrite; a bucket left empty is overwritten with
   no rows by a static partition overwrite).

Replaying a batch after a failure: updates, deletes and set-null are idempotent,
and inserts carry IDs fixed from the high-water mark stored for the batch before,
so a second run finds them present and adds nothing.  A batch that updates a key
before it inserts it is the exception (the second run would find the row there to
update); such batches go through a ledger (``referential.unapplied``).
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from larder.operators.changes import apply_changes, assign_ids, id_floor
from larder.schemas import PRIMARY_KEYS, SCHEMAS, children_of, ddl
from larder.session import ensure_checkpoint_dir
from larder.sources.tables import read_if_written

BUCKET = "bucket"


def bucket_of(key: str | Column, n: int) -> Column:
    col = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.xxhash64(col.cast("bigint")), F.lit(n)).cast("int")


def _cols(table: str) -> list[str]:
    return [f.name for f in SCHEMAS[table].fields]


def create_bucketed(spark: SparkSession, name: str, table: str, path: str, df: DataFrame, n: int) -> None:
    """Create catalog table ``name`` at ``path`` and load ``df`` into it."""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({ddl(table)}, `{BUCKET}` int) USING parquet "
        f"PARTITIONED BY ({BUCKET}) LOCATION '{path}'"
    )
    key = PRIMARY_KEYS[table]
    # One task holds a whole bucket (keys are unique, so buckets are even): one file each.
    df.select(*_cols(table), bucket_of(key, n).alias(BUCKET)).repartition(n, BUCKET).write.mode("overwrite").insertInto(name)


def read_bucketed(spark: SparkSession, name: str, table: str, buckets: list[int] | None = None) -> DataFrame:
    """The current rows (optionally only some buckets) of a bucketed table.

    The file listing is refreshed first: batches may have been applied by the
    streaming query's own session since this session last listed the table.
    """
    spark.catalog.refreshTable(name)
    df = spark.table(name)
    if buckets is not None:
        df = df.where(F.col(BUCKET).isin(buckets))
    return df.select(*_cols(table))


def _bucket_list(keys: DataFrame, n: int) -> list[int]:
    """The distinct buckets of a key column: at most ``n`` small numbers."""
    return sorted(r[0] for r in keys.select(bucket_of(keys.columns[0], n).alias("b")).distinct().collect())


def _overwrite_present_buckets(spark: SparkSession, staged: DataFrame, name: str) -> None:
    """Replace exactly the buckets that occur in ``staged`` (dynamic
    partition overwrite); every other bucket of ``name`` stays as it is."""
    key = "spark.sql.sources.partitionOverwriteMode"
    old = spark.conf.get(key)
    spark.conf.set(key, "dynamic")
    try:
        staged.repartition(BUCKET).write.mode("overwrite").insertInto(name)  # one file a bucket
    finally:
        spark.conf.set(key, old)


def _affected_keys(spark: SparkSession, names: dict[str, str], table: str, dead: DataFrame) -> dict[str, DataFrame]:
    """Per child table (recursively for cascades): keys of rows whose
    reference is among ``dead`` keys of ``table``."""
    out: dict[str, DataFrame] = {}
    dead = (dead.select(F.col(dead.columns[0]).alias("_dead")).distinct())
    for fk in children_of(table):
        if fk.child not in names:
            continue
        child = spark.table(names[fk.child]).select(PRIMARY_KEYS[fk.child], fk.column)
        hit = child.join(dead, child[fk.column] == dead["_dead"], "left_semi").select(PRIMARY_KEYS[fk.child])
        out[fk.child] = hit if fk.child not in out else out[fk.child].unionByName(hit)
        if fk.on_delete == "cascade":
            for k, v in _affected_keys(spark, names, fk.child, hit).items():
                out[k] = v if k not in out else out[k].unionByName(v)
    return out


def apply_incremental(spark: SparkSession, names: dict[str, str], table: str, changes: DataFrame,
                      n: int, high_water: DataFrame | None) -> DataFrame:
    """Apply one batch to the bucketed tables ``names`` (table -> catalog name).

    Returns the new auto-increment high-water mark (one row, column ``hwm``),
    checkpointed; the caller stores it with the batch.
    """
    ensure_checkpoint_dir(spark)
    for name in names.values():
        spark.catalog.refreshTable(name)  # file listings may predate the last batch
    key = PRIMARY_KEYS[table]
    # 1. IDs for inserts that have none, above the stored high-water mark.
    inserts = changes.where((F.col("op") == "I") & F.col(key).isNull())
    floor_frames = [changes.where(F.col(key).isNotNull()).select(key)]
    if high_water is not None:
        floor_frames.append(high_water.select(F.col("hwm").cast("bigint").alias(key)))
    else:
        floor_frames.append(spark.table(names[table]).select(key))
    floor = id_floor(*floor_frames, key=key)
    with_ids = assign_ids(inserts, inserts, key, ["seq"], floor)
    changes = changes.where(~((F.col("op") == "I") & F.col(key).isNull())).unionByName(
        with_ids.select(*changes.columns)
    ).checkpoint(eager=True)

    # 2. Affected keys per table, then the touched buckets of each.
    affected = {table: changes.select(key)}
    affected.update(_affected_keys(spark, names, table, changes.where(F.col("op") == "D").select(key)))
    touched = {t: _bucket_list(k, n) for t, k in affected.items()}

    # 3. Run the batch jobs on the touched buckets only, stage, overwrite.
    current = {t: read_bucketed(spark, names[t], t, b) for t, b in touched.items()}
    new = apply_changes(current, table, changes, high_water=None if high_water is None else high_water.select("hwm"))
    for t, buckets in touched.items():
        if not buckets:
            continue
        staged = new[t].select(*_cols(t), bucket_of(PRIMARY_KEYS[t], n).alias(BUCKET)).checkpoint(eager=True)
        _overwrite_present_buckets(spark, staged, names[t])
        present = set(_bucket_list(staged.select(PRIMARY_KEYS[t]), n))
        emptied = sorted(set(buckets) - present)
        if emptied:
            # A bucket whose rows were all deleted: overwrite it with no rows.
            view = f"_larder_empty_{t}"
            spark.createDataFrame([], SCHEMAS[t]).createOrReplaceTempView(view)
            cols = ", ".join(f"`{c}`" for c in _cols(t))
            for b in emptied:
                spark.sql(f"INSERT OVERWRITE TABLE {names[t]} PARTITION ({BUCKET} = {b}) SELECT {cols} FROM {view}")
        spark.catalog.refreshTable(names[t])

    hwm = changes.select(F.col(key).cast("bigint").alias("hwm"))
    if high_water is not None:
        hwm = hwm.unionByName(high_water.select(F.col("hwm").cast("bigint")))
    else:
        hwm = hwm.unionByName(spark.table(names[table]).select(F.col(key).cast("bigint").alias("hwm")))
    return hwm.agg(F.max("hwm").alias("hwm")).checkpoint(eager=True)


def start_incremental_feed(spark: SparkSession, changes_dir: str, names: dict[str, str], table: str,
                           n: int, state_dir: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Stream change files into the bucketed tables, one batch at a time.

    ``state_dir`` keeps the high-water mark per batch (``v=<batch id>``).
    """
    from larder.streaming.change_feed import change_schema

    key = PRIMARY_KEYS[table]
    if read_if_written(spark, os.path.join(state_dir, "v=0")) is None:  # first start: the mark before any batch
        spark.table(names[table]).agg(F.max(F.col(key).cast("bigint")).alias("hwm")).write.mode(
            "overwrite").parquet(os.path.join(state_dir, "v=0"))

    def handle(batch: DataFrame, batch_id: int) -> None:
        # Batch b always starts from the mark stored for b, so a replay
        # assigns the same IDs as the first attempt.
        hw = spark.read.parquet(os.path.join(state_dir, f"v={batch_id}"))
        hwm = apply_incremental(batch.sparkSession, names, table, batch, n, hw)
        hwm.write.mode("overwrite").parquet(os.path.join(state_dir, f"v={batch_id + 1}"))

    stream = spark.readStream.schema(change_schema(table)).parquet(changes_dir)
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
