"""The notebook's load flow as one Spark job chain: CSV -> clean -> audit -> load.

``load_from_csv`` reads the four raw files (A1), cleans each table (C12),
sets aside rows that would break a key (I1) or a reference (I2), and writes
the rest as version 0 of the versioned tables (A7), parents first.  The
original load had no such step: one bad reference failed the whole insert.

Quarantined rows are written next to the tables (``_quarantine/<table>``),
with a ``reason`` column, instead of failing the load.  Raw rows whose date text
is no date are written as they are to ``_quarantine/<table>_dates``, lines that do
not fit the table to ``_quarantine/<table>_lines``.  Whether a date column is
written day first is found from the whole column before it is parsed.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.operators.clean import CLEANERS, DATE_COLUMNS, column_day_first, unparsed_dates
from larder.schemas import LOAD_ORDER, PRIMARY_KEYS, parents_of
from larder.session import ensure_checkpoint_dir
from larder.sources.csv import read_table_csv_split
from larder.sources.tables import write_version

# --- fixed values: raw file name of each table ---------------------------------
RAW_FILES = {
    "providers": "providers_data.csv",
    "receivers": "receivers_data.csv",
    "food_listings": "food_listings_data.csv",
    "claims": "claims_data.csv",
}


def split_duplicate_keys(df: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is non-null and unique, rows with a null or repeated key).

    Keys are counted with a partial + final aggregation (a key repeated
    across a third of the table is combined map-side), and the rows are then
    split by semi / anti join against the repeated keys only.
    """
    key = PRIMARY_KEYS[table]
    keyed = df.where(F.col(key).isNotNull())
    repeated = (keyed.groupBy(key).count().where(F.col("count") > 1).select(F.col(key).alias("_dup")))
    good = keyed.join(repeated, keyed[key] == repeated["_dup"], "left_anti")
    bad = df.where(F.col(key).isNull()).unionByName(
        keyed.join(repeated, keyed[key] == repeated["_dup"], "left_semi")
    )
    return good, bad.withColumn("reason", F.lit(f"primary key {key} null or repeated"))


def split_dangling(df: DataFrame, table: str, parents: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(rows whose non-null references all exist, rows with a dangling one)."""
    if not parents_of(table):
        return df, None
    # One left join per reference against the parent's unique keys marks the
    # rows; AQE splits the partition of a hot parent.
    marked, reasons = df, []
    for i, fk in enumerate(parents_of(table)):
        pk, found = f"_pk{i}", f"_found{i}"
        keys = parents[fk.parent].select(F.col(PRIMARY_KEYS[fk.parent]).alias(pk), F.lit(True).alias(found))
        marked = marked.join(keys, marked[fk.column] == keys[pk], "left").drop(pk)
        dangling = F.col(fk.column).isNotNull() & F.col(found).isNull()
        reasons.append(F.when(dangling, F.lit(f"{fk.column} has no {fk.parent} row")))
    marked = marked.withColumn("reason", F.coalesce(*reasons)).select(*df.columns, "reason")
    return marked.where(F.col("reason").isNull()).drop("reason"), marked.where(F.col("reason").isNotNull())


def load_from_csv(spark: SparkSession, csv_dir: str, root: str) -> dict[str, DataFrame]:
    """Read, clean, audit and write version 0 of the four tables under ``root``.

    Returns the loaded tables (read back from ``root``).  Each table is
    checkpointed once after its audits, so the clean/audit work is not
    repeated by the write and by the children's reference checks.
    """
    ensure_checkpoint_dir(spark)
    loaded: dict[str, DataFrame] = {}
    for table in LOAD_ORDER:
        # The file is parsed once; what follows reads the checkpointed rows.
        raw, lines = read_table_csv_split(spark, os.path.join(csv_dir, RAW_FILES[table]), table)
        lines.write.mode("overwrite").parquet(os.path.join(root, "_quarantine", f"{table}_lines"))
        if table in DATE_COLUMNS:
            day_first = column_day_first(raw, table)
            unparsed_dates(raw, table, day_first).write.mode("overwrite").parquet(os.path.join(root, "_quarantine", f"{table}_dates"))
            raw = CLEANERS[table](raw, day_first)
        else:
            raw = CLEANERS[table](raw)
        # Cleaned once; the audits, the quarantine and the table read the copy.
        clean = raw.checkpoint(eager=True)
        good, dup = split_duplicate_keys(clean, table)
        good, dangling = split_dangling(good, table, loaded)
        good = good.checkpoint(eager=True)
        quarantine = dup if dangling is None else dup.unionByName(dangling)
        quarantine.write.mode("overwrite").parquet(os.path.join(root, "_quarantine", table))
        write_version(good, root, table, 0)
        loaded[table] = good
    return loaded
