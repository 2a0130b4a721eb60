"""Relational-database source (A4).

The original application reads and writes its tables through a database
connection.  Here a table is read in parallel with Spark's JDBC source,
partitioned on the integer primary key so that ``num_partitions`` tasks each
fetch one key range.  Connection settings come from arguments or from the
environment (``LARDER_JDBC_URL``, ``LARDER_JDBC_USER``,
``LARDER_JDBC_PASSWORD``); credentials are never written in code.  The JDBC
driver jar must be on the cluster classpath.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, DataFrameReader, SparkSession

from larder.schemas import PRIMARY_KEYS


def jdbc_options(url: str | None = None, user: str | None = None, password: str | None = None,
                 **extra: str) -> dict[str, str]:
    opts = {
        "url": url or os.environ.get("LARDER_JDBC_URL", ""),
        "user": user or os.environ.get("LARDER_JDBC_USER", ""),
        "password": password or os.environ.get("LARDER_JDBC_PASSWORD", ""),
        "fetchsize": "10000",
    }
    opts.update(extra)
    if not opts["url"]:
        raise ValueError("no JDBC url: pass url= or set LARDER_JDBC_URL")
    return {k: v for k, v in opts.items() if v != ""}


def jdbc_reader(spark: SparkSession, table: str, lower: int, upper: int, num_partitions: int,
                partition_column: str | None = None, **conn: str) -> DataFrameReader:
    """A reader for ``table`` split into ``num_partitions`` primary-key ranges."""
    reader = spark.read.format("jdbc").options(**jdbc_options(**conn))
    return reader.options(
        dbtable=table,
        partitionColumn=partition_column or PRIMARY_KEYS[table],
        lowerBound=str(lower),
        upperBound=str(upper),
        numPartitions=str(num_partitions),
    )


def read_jdbc(spark: SparkSession, table: str, lower: int, upper: int, num_partitions: int,
              partition_column: str | None = None, **conn: str) -> DataFrame:
    """A4: read ``table`` over JDBC in parallel key ranges."""
    return jdbc_reader(spark, table, lower, upper, num_partitions, partition_column, **conn).load()


def write_jdbc(df: DataFrame, table: str, mode: str = "append", **conn: str) -> None:
    """Write a DataFrame to a database table (each task opens one connection)."""
    df.write.format("jdbc").options(**jdbc_options(**conn)).option("dbtable", table).mode(mode).save()
