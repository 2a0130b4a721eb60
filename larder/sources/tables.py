"""Table creation, loading and versioned scans.

Tables are parquet.  Parquet tables reject primary keys, constraints and
UPDATE/DELETE, so (a) the constraints are enforced by the audits in
``larder.operators.integrity`` before a load, and (b) changes are written as
new versions: ``<root>/<table>/v=<n>``, read back by selecting the highest
complete version (partition pruning on ``v``).
"""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.schemas import LOAD_ORDER, PRIMARY_KEYS, SCHEMAS, ddl
from larder.session import ensure_checkpoint_dir


def create_schema(spark: SparkSession, database: str | None = None, location: str | None = None) -> list[str]:
    """``CREATE TABLE IF NOT EXISTS`` for the four tables (parquet).

    Returns the qualified table names, parents first.
    """
    names = []
    for table in LOAD_ORDER:
        qualified = f"{database}.{table}" if database else table
        loc = f" LOCATION '{os.path.join(location, table)}'" if location else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {qualified} ({ddl(table)}) USING parquet{loc}")
        names.append(qualified)
    return names


def scan_table(spark: SparkSession, name: str) -> DataFrame:
    """A2: full scan of a catalog table."""
    return spark.table(name)


def new_rows_only(existing: DataFrame, incoming: DataFrame, table: str) -> DataFrame:
    """Rows of ``incoming`` whose key is not in ``existing`` (duplicate-safe append).

    A key that ``incoming`` repeats enters once, with its smallest row.
    """
    key = PRIMARY_KEYS[table]
    others = [c for c in incoming.columns if c != key]
    incoming = incoming.groupBy(key).agg(F.min(F.struct(*others)).alias("_row")).select(key, "_row.*").select(*incoming.columns)
    keys = existing.select(F.col(key).alias("_k"))
    return incoming.join(keys, incoming[key] == keys["_k"], "left_anti")


def load_tables(spark: SparkSession, frames: dict[str, DataFrame], database: str | None = None) -> None:
    """Append cleaned frames to the catalog tables, parents first.

    A plain append would silently duplicate keys on a re-run; only rows with
    new keys are appended.  Run ``pk_violations``/``fk_violations`` on the
    frames first to quarantine bad rows.
    """
    for table in LOAD_ORDER:
        if table not in frames:
            continue
        qualified = f"{database}.{table}" if database else table
        cols = [f.name for f in SCHEMAS[table].fields]
        incoming = frames[table].select(*cols)
        fresh = new_rows_only(spark.table(qualified), incoming, table)
        # Materialise before writing into the table that the anti-join reads.
        ensure_checkpoint_dir(spark)
        fresh = fresh.checkpoint(eager=True)
        fresh.write.mode("append").insertInto(qualified)


def write_version(df: DataFrame, root: str, table: str, version: int) -> str:
    """Write ``df`` as version ``version`` of ``table`` (idempotent overwrite of
    that version only), then point ``_latest`` at it; returns its path.

    Data first, pointer second: a failure in between leaves the pointer on the
    previous complete version, and rerunning the write replaces the partial
    folder.  (``_``-prefixed paths are ignored by parquet dataset reads.)
    """
    path = os.path.join(root, table, f"v={version}")
    df.write.mode("overwrite").parquet(path)
    df.sparkSession.createDataFrame([(int(version),)], "version long").write.mode("overwrite").parquet(
        os.path.join(root, table, "_latest")
    )
    return path


def read_if_written(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """The parquet data at ``path``; None if the path is missing.  Any other error is raised."""
    try:
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def latest_version(spark: SparkSession, root: str, table: str) -> int | None:
    """Version named by the ``_latest`` pointer; None if no pointer was written.

    Only a missing path means "nothing written"; any other error is raised.
    """
    pointer = read_if_written(spark, os.path.join(root, table, "_latest"), "version long")
    if pointer is None:
        return None
    row = pointer.agg(F.max("version")).first()
    return None if row[0] is None else int(row[0])


def read_version(spark: SparkSession, root: str, table: str, version: int | None = None) -> DataFrame:
    """Read one version (default: latest) of a versioned table."""
    if version is None:
        version = latest_version(spark, root, table)
        if version is None:
            raise FileNotFoundError(f"no version of {table} below {root}")
    return spark.read.parquet(os.path.join(root, table, f"v={version}")).select(
        *[f.name for f in SCHEMAS[table].fields]
    )


# Keys by which a table version is clustered: a file covers a narrow range of the
# column that the expiry and recency filters use, so min/max statistics skip whole
# files.  The primary key comes second: a date that a third of all rows share is
# spread over several files.
WRITE_SORT = {"food_listings": ("Expiry_Date", "Food_ID"), "claims": ("Timestamp", "Claim_ID")}


def clustered(df: DataFrame, table: str, files: int | None = None) -> DataFrame:
    """``df`` range-partitioned and sorted by the table's clustering keys (one shuffle).

    ``files`` fixes the number of ranges; by default Spark's shuffle setting and
    the sizes found at run time decide.
    """
    keys = WRITE_SORT.get(table)
    if not keys:
        return df
    ranged = df.repartitionByRange(files, *keys) if files else df.repartitionByRange(*keys)
    return ranged.sortWithinPartitions(*keys)


def write_tables(tables: dict[str, DataFrame], root: str, version: int = 0, files: int | None = None) -> dict[str, str]:
    """Write every table as ``version``, clustered; returns the paths."""
    paths = {}
    for name, df in tables.items():
        cols = [f.name for f in SCHEMAS[name].fields]
        paths[name] = write_version(clustered(df.select(*cols), name, files), root, name, version)
    return paths


def read_tables(spark: SparkSession, root: str, names=LOAD_ORDER, version: int | None = None) -> dict[str, DataFrame]:
    """The given version (default: latest) of every table under ``root``."""
    return {name: read_version(spark, root, name, version) for name in names}
