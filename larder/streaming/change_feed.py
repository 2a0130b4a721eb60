"""Continuous change application with Structured Streaming.

The original forms insert, update and delete one row at a time as users
submit them.  At scale those edits arrive as a feed of change records; this
module applies each micro-batch of the feed to the current table version with
the batch jobs of ``larder.operators.changes`` and writes the result as the
next version.

* Source: parquet change files appearing in a directory (any streaming
  source with the same schema works, e.g. a message bus).
* ``foreachBatch`` runs the batch job on every micro-batch: batch ``b``
  reads version ``b`` of the tables and writes version ``b + 1``; writing a
  version overwrites only that version's folder and then moves the
  ``_latest`` pointer.  A batch replayed after a failure therefore starts
  from the same input and rewrites the same output (idempotent).  The
  streaming checkpoint records which files were consumed, so a restarted
  query continues where it stopped.
* The initial tables must be written as version 0 (``write_tables``).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from larder.operators.changes import apply_changes
from larder.schemas import PRIMARY_KEYS, SCHEMAS
from larder.session import ensure_checkpoint_dir
from larder.sources.tables import read_if_written, read_version, write_version


def _read_high_water(spark: SparkSession, root: str, name: str, version: int) -> DataFrame | None:
    """The auto-increment high-water mark stored with ``version`` (if any)."""
    mark = read_if_written(spark, os.path.join(root, name, f"v={version}"))
    return None if mark is None else mark.select("hwm")


def change_schema(table: str) -> T.StructType:
    """op, seq, set + the table's columns (all nullable)."""
    fields = [
        T.StructField("op", T.StringType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("set", T.ArrayType(T.StringType()), True),
    ]
    fields += [T.StructField(f.name, f.dataType, True) for f in SCHEMAS[table].fields]
    return T.StructType(fields)


def make_batch_handler(root: str, table: str, related: tuple[str, ...] = ()):
    """The ``foreachBatch`` function: read current versions, apply, write next."""

    key = PRIMARY_KEYS[table]
    hwm_table = f"_high_water_{table}"

    def handle(batch: DataFrame, batch_id: int) -> None:
        # Batch b reads version b and writes version b + 1 -- explicit
        # versions, not "latest", so a batch replayed after a failure starts
        # from the same input and rewrites the same output.
        spark = batch.sparkSession
        ensure_checkpoint_dir(spark)
        names = (table, *related)
        current = {name: read_version(spark, root, name, batch_id) for name in names}
        previous_hwm = _read_high_water(spark, root, hwm_table, batch_id)
        new = apply_changes(current, table, batch, high_water=previous_hwm)
        # The version folders of this batch are written only after every new
        # frame is fully computed from the previous versions.
        staged = {name: new[name].checkpoint(eager=True) for name in names}
        hwm = staged[table].select(F.max(key).alias("hwm")).unionByName(
            current[table].select(F.max(key).alias("hwm")))
        if previous_hwm is not None:
            hwm = hwm.unionByName(previous_hwm)
        hwm = hwm.agg(F.max("hwm").alias("hwm")).checkpoint(eager=True)
        for name in names:
            write_version(staged[name], root, name, batch_id + 1)
        hwm.write.mode("overwrite").parquet(os.path.join(root, hwm_table, f"v={batch_id + 1}"))

    return handle


def start_change_feed(spark: SparkSession, changes_dir: str, root: str, table: str, checkpoint: str,
                      related: tuple[str, ...] = (), available_now: bool = True) -> StreamingQuery:
    """Stream change files from ``changes_dir`` into versions under ``root``."""
    stream = spark.readStream.schema(change_schema(table)).parquet(changes_dir)
    writer = stream.writeStream.foreachBatch(make_batch_handler(root, table, related)).option(
        "checkpointLocation", checkpoint
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
