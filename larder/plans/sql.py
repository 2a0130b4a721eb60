"""SQL entry point with bound parameters (A3).

``run_query`` registers the tables as temporary views and hands the text to
``spark.sql`` with named arguments (``:name`` markers), so user input is bound
as a literal and never spliced into the SQL.  The names are resolved at once, so
the views go again and views of the caller that had these names are back.
Errors propagate: a failing query raises instead of returning an empty result.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession


def register_views(tables: dict[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def run_query(spark: SparkSession, sql: str, params: dict[str, Any] | None = None,
              tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """A3: ``sql`` with ``:name`` parameters bound from ``params``."""
    catalog = spark.catalog
    tables = tables or {}
    own = {n: spark.table(n) for n in tables if catalog.tableExists(n) and catalog.getTable(n).isTemporary}
    register_views(tables)
    try:
        return spark.sql(sql, args=params or None)
    finally:
        for name in tables:
            catalog.dropTempView(name)
        register_views(own)
