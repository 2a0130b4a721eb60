"""Table profiling (B1-B4): shape, null counts, column summary, preview.

Every profile is one aggregation pass over the table (all columns in a single
``agg``), followed by an ``unpivot`` of the one-row result into one row per
column.  Nothing is collected to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table_shape(df: DataFrame) -> DataFrame:
    """B1: one row (n_rows, n_cols)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(len(df.columns)).alias("n_cols")
    )


def _is_missing(df: DataFrame, c: str):
    col = F.col(f"`{c}`")
    if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType)):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def _unpivot(one_row: DataFrame, names: list[str], value_name: str) -> DataFrame:
    return one_row.unpivot([], [F.col(f"`{n}`") for n in names], "column_name", value_name)


def null_profile(df: DataFrame) -> DataFrame:
    """B2: (column_name, null_count); NaN counts as missing in float columns."""
    one = df.agg(*[F.count_if(_is_missing(df, c)).alias(c) for c in df.columns])
    return _unpivot(one, df.columns, "null_count")


def column_profile(df: DataFrame) -> DataFrame:
    """(column_name, non_null_count, data_type) like ``DataFrame.info()``."""
    one = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns])
    counts = _unpivot(one, df.columns, "non_null_count")
    types = F.create_map(*[x for f in df.schema.fields for x in (F.lit(f.name), F.lit(f.dataType.simpleString()))])
    return counts.select("column_name", "non_null_count", types[F.col("column_name")].alias("data_type"))


def preview(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    """First ``n`` rows by ``key`` (deterministic ``head``)."""
    return df.orderBy(key).limit(n)
