"""Named queries over the driver tables, each with its DuckDB oracle text.

``queries()[name](spark, sf_dir)`` builds the four tables from the driver's
parquet files (``larder.sources.driver``) and runs one operator over the
*whole* tables.  ``oracle_sql()[name]`` is the same question in plain SQL over
the same mapping, used as an independent check.

Parameters (dates, cities, search text, facet values) are fixed here so that
the check is reproducible; they select by the feature being exercised, never
to shrink the input.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from larder.sources.driver import ORACLE_VIEWS_SQL, DriverTables

AS_OF = dt.date(1998, 6, 1)
AS_OF_SQL = "DATE '1998-06-01'"


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[DriverTables], DataFrame]
    oracle: str | None


REGISTRY: dict[str, Query] = {}


def register(name: str, oracle: str | None):
    def deco(fn: Callable[[DriverTables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"duplicate query name {name}")
        REGISTRY[name] = Query(name, fn, oracle)
        return fn

    return deco


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    # Importing the query modules fills REGISTRY.
    from larder.plans import driver_audits, driver_batches, driver_panels, driver_queries, driver_raw  # noqa: F401

    def bind(q: Query):
        return lambda spark, sf_dir: q.build(DriverTables(spark, sf_dir))

    return {name: bind(q) for name, q in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    from larder.plans import driver_audits, driver_batches, driver_panels, driver_queries, driver_raw  # noqa: F401

    return {name: ORACLE_VIEWS_SQL + q.oracle for name, q in REGISTRY.items() if q.oracle is not None}
