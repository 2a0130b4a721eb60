"""Table-cleaning jobs (C4-C12), one lazy function per table.

Each pipeline is a single projection + filter chain of native expressions, so
the whole job is narrow (one pass, pushed-down projection) except for the
duplicate-row removal of listings and claims, which is one shuffle.  That
shuffle combines map-side: a block of identical rows -- even a third of the
input -- is reduced inside each map task before anything is exchanged.

Inputs may be raw string tables (read from CSV) or already typed tables;
conversions look at the input type and only parse what is still text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.functions.coerce import (
    cast_key, coerce_date, coerce_quantity, coerce_timestamp, day_first_of, layout_counts, positive_quantity, try_key,
)
from larder.functions.text import clean_address, clean_text, digits_only, strip_title
from larder.schemas import SCHEMAS

# --- fixed values: the cleaned columns
TEXT_COLUMNS = ("Name", "Type", "City")
LISTING_TITLE_COLUMNS = ("Food_Name", "Provider_Type", "Location", "Food_Type", "Meal_Type")


def _type(df: DataFrame, c: str) -> T.DataType:
    return df.schema[c].dataType


def _lenient_key(df: DataFrame, c: str) -> Column:
    """Numeric key as bigint; text is parsed leniently (bad -> null)."""
    if isinstance(_type(df, c), (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
        return F.col(c).cast("bigint")
    return try_key(c)


def _strict_key(df: DataFrame, c: str) -> Column:
    if isinstance(_type(df, c), (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
        return F.col(c).cast("bigint")
    return cast_key(c)


def _conform(df: DataFrame, table: str) -> DataFrame:
    """Select the declared columns, in declared order, with declared types."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SCHEMAS[table].fields])


def clean_providers(raw: DataFrame) -> DataFrame:
    """C12 providers: clean_text on Name/Type/City, clean_address on Address,
    digits-only Contact, strict integer Provider_ID.  No rows are dropped."""
    return _conform(
        raw.select(
            _strict_key(raw, "Provider_ID").alias("Provider_ID"),
            *[clean_text(c).alias(c) for c in TEXT_COLUMNS],
            clean_address("Address").alias("Address"),
            digits_only("Contact").alias("Contact"),
        ),
        "providers",
    )


def clean_receivers(raw: DataFrame) -> DataFrame:
    """C12 receivers: digits-only Contact, clean_text on Name/Type/City."""
    return _conform(
        raw.select(
            _strict_key(raw, "Receiver_ID").alias("Receiver_ID"),
            *[clean_text(c).alias(c) for c in TEXT_COLUMNS],
            digits_only("Contact").alias("Contact"),
        ),
        "receivers",
    )


def clean_listings(raw: DataFrame, day_first: bool | Column = False) -> DataFrame:
    """C12 listings: coerce expiry; keep positive numeric quantity; strip and
    title-case the five text columns; drop fully duplicated rows."""
    typed = raw.where(positive_quantity("Quantity", _type(raw, "Quantity"))).select(
        _strict_key(raw, "Food_ID").alias("Food_ID"),
        strip_title("Food_Name").alias("Food_Name"),
        coerce_quantity("Quantity", _type(raw, "Quantity")).alias("Quantity"),
        coerce_date("Expiry_Date", _type(raw, "Expiry_Date"), day_first).alias("Expiry_Date"),
        _lenient_key(raw, "Provider_ID").alias("Provider_ID"),
        *[strip_title(c).alias(c) for c in LISTING_TITLE_COLUMNS[1:]],
    )
    return _conform(typed.dropDuplicates(), "food_listings")


def clean_claims(raw: DataFrame, day_first: bool | Column = False) -> DataFrame:
    """C12 claims: coerce Timestamp; strip and title-case Status; drop
    duplicated rows; keep rows whose three IDs are all > 0 and whose
    Timestamp parsed."""
    typed = raw.select(
        _lenient_key(raw, "Claim_ID").alias("Claim_ID"),
        _lenient_key(raw, "Food_ID").alias("Food_ID"),
        _lenient_key(raw, "Receiver_ID").alias("Receiver_ID"),
        strip_title("Status").alias("Status"),
        coerce_timestamp("Timestamp", _type(raw, "Timestamp"), day_first).alias("Timestamp"),
    )
    valid = (
        (F.col("Claim_ID") > 0) & (F.col("Food_ID") > 0) & (F.col("Receiver_ID") > 0)
        & F.col("Timestamp").isNotNull()
    )
    # The filter only reads columns that dropDuplicates keeps whole, so
    # applying it first returns the same rows and shuffles fewer of them.
    return _conform(typed.where(valid).dropDuplicates(), "claims")


# Date column of each table that has one.
DATE_COLUMNS = {"food_listings": "Expiry_Date", "claims": "Timestamp"}


def column_day_first(raw: DataFrame, table: str) -> Column | bool:
    """Whether the table's date column, still text, is written day first."""
    c = DATE_COLUMNS[table]
    return day_first_of(layout_counts(raw, c)) if isinstance(_type(raw, c), T.StringType) else False


def unparsed_dates(raw: DataFrame, table: str, day_first: bool | Column = False) -> DataFrame:
    """Rows of ``raw`` whose date text is present but not a date (C5 makes it
    null, and claims without a timestamp are dropped): for a quarantine."""
    c = DATE_COLUMNS[table]
    return raw.where(F.col(c).isNotNull() & coerce_timestamp(c, _type(raw, c), day_first).isNull())


CLEANERS = {
    "providers": clean_providers,
    "receivers": clean_receivers,
    "food_listings": clean_listings,
    "claims": clean_claims,
}


def clean_all(raw_tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {name: CLEANERS[name](df) for name, df in raw_tables.items()}
