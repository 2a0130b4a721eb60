"""CSV sources and sinks.

Raw files are read with every column as text; quotes are escaped by doubling.
Provider and receiver records may span lines (addresses hold newlines), so
``multiLine`` is on for them and such a file is one task.  Listings and claims
are one line per record and their files are split between tasks.  At scale the
raw files are converted once (``read_table_csv`` -> clean -> parquet) and every
later job reads the parquet copy.

``read_table_csv`` raises at a line with more or fewer fields than the header:
nothing is cut or filled silently.  That also holds for a record over several
lines where ``multiLine`` is off.  ``read_table_csv_split`` loads what can be
loaded: short lines are filled with nulls, lines that do not fit are set aside
with their text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.functions.coerce import na_to_null
from larder.schemas import SCHEMAS
from larder.session import ensure_checkpoint_dir

CSV_READ_OPTIONS = {
    "header": "true",
    "escape": '"',
    "quote": '"',
    "mode": "FAILFAST",
    "inferSchema": "false",
    # Pruned columns are not parsed, and lines of wrong length would pass.
    "columnPruning": "false",
}
#: Tables whose records never span lines.
ONE_LINE = ("food_listings", "claims")


def read_table_csv(spark: SparkSession, path: str, table: str | None = None, multi_line: bool | None = None) -> DataFrame:
    """A1: CSV with header -> DataFrame of strings, pandas NA tokens as null.

    With ``table`` the declared columns are selected (in declared order);
    a missing column raises, as it would in the load.  ``multi_line`` (default:
    on, but for ``ONE_LINE`` tables) allows newlines inside quoted values.
    """
    if multi_line is None:
        multi_line = table not in ONE_LINE
    raw = spark.read.options(**CSV_READ_OPTIONS, multiLine=multi_line).csv(path)
    cols = [f.name for f in SCHEMAS[table].fields] if table else raw.columns
    return raw.select(*[na_to_null(F.col(f"`{c}`")).alias(c) for c in cols])


#: The text of a line that does not fit, while it is sorted out.
LINE = "_line"


def line_fault(line: Column, n_fields: int) -> Column:
    """Why a line does not fit ``n_fields`` columns; null for a line that is only short."""
    quotes = F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))
    bare = F.regexp_replace(line, r'"(?:[^"]|"")*"', "")
    fields = F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1
    return (
        F.when(quotes % 2 == 1, "open quote")
        .when(fields > n_fields, "too many fields")
        .when(fields == n_fields, "broken field")
    )


def read_table_csv_split(
    spark: SparkSession, path: str, table: str, multi_line: bool | None = None, header: bool = True
) -> tuple[DataFrame, DataFrame]:
    """A1 over faulty files: (rows as ``read_table_csv`` gives them, (line, reason) of what was set aside).

    The parser marks every line whose number of fields is not the header's, or
    whose quotes are broken.  Short lines are kept, their missing values null;
    of the others no part is loaded.  The files are parsed once: both results
    read one checkpointed copy.  Without ``header`` the declared columns are
    expected in declared order.
    """
    if multi_line is None:
        multi_line = table not in ONE_LINE
    declared = [f.name for f in SCHEMAS[table].fields]
    options = CSV_READ_OPTIONS | {"header": str(header).lower(), "multiLine": str(multi_line).lower()}
    names = spark.read.options(**options | {"mode": "PERMISSIVE"}).csv(path).columns if header else declared
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, LINE]])
    options |= {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": LINE}
    ensure_checkpoint_dir(spark)
    raw = spark.read.schema(schema).options(**options).csv(path).checkpoint(eager=True)
    told = raw.withColumn("reason", F.when(F.col(LINE).isNotNull(), line_fault(F.col(LINE), len(names))))
    rows = told.where(F.col("reason").isNull()).select(*[na_to_null(F.col(f"`{c}`")).alias(c) for c in declared])
    return rows, told.where(F.col("reason").isNotNull()).select(F.col(LINE).alias("line"), "reason")


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write a DataFrame as CSV with a header (a directory of parts).

    Values holding the delimiter, quotes or newlines are quoted, so the
    output reads back with ``read_table_csv``.
    """
    # The writer trims by default; values keep their edge spaces.
    keep = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    df.write.mode(mode).options(header="true", escape='"', quote='"', **keep).csv(path)
