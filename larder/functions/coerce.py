"""Type coercion with pandas ``errors='coerce'`` semantics.

ANSI mode is on in Spark 4, so every lenient conversion is written with a
``try_*`` form: bad input becomes null instead of failing the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A time of day after a date: hour, minute, second with fraction, AM/PM, zone.
_CLOCK = (
    r"(?:(?:T|\s)\s*(\d{1,2}):(\d{2})(?::(\d{2}(?:\.\d{1,6})?)\d{0,3})?"
    r"\s*([AaPp][Mm])?\s*(?:Z|UTC|[+-]\d{2}:?\d{2})?)?$"
)
# Accepted dates and their parts as year|month|day|hour|minute|second|half.
# Numbers with the year last are read month first unless the column is day first;
# a number over 12 is no month, so such text is not parsed.
_YEAR_LAST = r"^(\d{1,2})([-/])(\d{1,2})\2(\d{4})"
_DATES = (
    (r"^(\d{4})([-/])(\d{1,2})\2(\d{1,2})", "$1|$3|$4|$5|$6|$7|$8"),
    (r"^(\d{4})(\d{2})(\d{2})", "$1|$2|$3|$4|$5|$6|$7"),
    (_YEAR_LAST, "$4|$1|$3|$5|$6|$7|$8"),
    (_YEAR_LAST, "$4|$3|$1|$5|$6|$7|$8"),
    (r"^([A-Za-z]{3,9})\.?\s+(\d{1,2})(?:,\s*|\s+)(\d{4})", "$3|$1|$2|$4|$5|$6|$7"),
    (r"^(\d{1,2})[\s-]([A-Za-z]{3,9})[\s-](\d{4})", "$3|$2|$1|$4|$5|$6|$7"),
)

# --- fixed values: English month names ----------------------------------------
MONTHS = (
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
)

# --- fixed values: strings read as missing (pandas read_csv defaults) --------
NA_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def na_to_null(c: str | Column) -> Column:
    """The pandas missing-value tokens become null."""
    col = _col(c)
    return F.when(col.isin(list(NA_TOKENS)), F.lit(None).cast("string")).otherwise(col)


def cast_key(c: str | Column) -> Column:
    """C4: strict cast to bigint (bad input raises under ANSI, as intended)."""
    return _col(c).cast("bigint")


def try_key(c: str | Column) -> Column:
    """Lenient key cast: non-numeric -> null, ``'3.0'`` -> 3.

    Integer text is cast exactly (no detour through double, which would lose
    precision above 2^53); only text like ``'3.0'`` takes the numeric route.
    """
    col = F.trim(_col(c).cast("string"))
    as_double = col.try_cast("double")
    from_double = F.when(
        as_double.isNotNull() & ~F.isnan(as_double) & (as_double == F.floor(as_double)),
        as_double.try_cast("bigint"),
    )
    return F.coalesce(col.try_cast("bigint"), from_double)


# What is left of an ISO text without its digits; such text is cast, not matched.
_ISO_FORMS = ("--", "-- :", "--T:", "-- ::", "--T::", "-- ::.", "--T::.")
_DIGITS = "0123456789"


def _all_digits(text: Column) -> Column:
    return F.translate(text, _DIGITS, "") == ""


def coerce_timestamp(c: str | Column, source_type: T.DataType | None = None, day_first: bool | Column = False) -> Column:
    """String -> timestamp_ntz; text that is no date becomes null.

    Timestamps pass through; dates become midnight.  ISO text is cast.  Other
    text is rewritten, by the one or two patterns that its first characters
    allow, to a list of parts and put together once with
    ``try_make_timestamp_ntz``, so neither bad nor unusual text raises (a failed
    parse per layout would cost an exception each).  The lambda binds the parts,
    so the patterns run once per value however the plan is collapsed.  A zone
    suffix is accepted and not applied: the column has no zone, and the clock
    time stays as written.  Fractions keep six digits.

    ``day_first`` says how numbers with the year last are read; it is one
    choice for a column (``day_first_of`` finds it), not one for a value.
    """
    col = _col(c)
    if isinstance(source_type, (T.TimestampNTZType,)):
        return col
    if isinstance(source_type, (T.TimestampType, T.DateType)):
        return col.cast("timestamp_ntz")
    s = F.trim(col.cast("string"))
    iso = F.when(F.translate(s, _DIGITS, "").isin(*_ISO_FORMS) & _all_digits(F.left(s, F.lit(4))) & (F.length(s) >= 8), s.try_cast("timestamp_ntz"))
    if isinstance(day_first, Column):  # may be a subquery, which no lambda can hold
        return F.coalesce(iso, F.when(day_first, _put_together(s, True)).otherwise(_put_together(s, False)))
    return F.coalesce(iso, _put_together(s, day_first))


def _put_together(s: Column, day_first: bool) -> Column:
    s = F.translate(s, "|", "?")
    matched = [lambda x, p=pattern, q=parts: F.regexp_replace(x, p + _CLOCK, q) for pattern, parts in _DATES]
    year_first, compact, month_first, day_first_too, month_name, day_month_name = matched
    year_last = day_first_too if day_first else month_first
    begin = F.lower(F.left(s, F.lit(1)))
    s = (
        F.when(begin.between("a", "z"), month_name(s))
        .when(_all_digits(F.left(s, F.lit(4))) & F.substring(s, 5, 1).isin("-", "/"), year_first(s))
        .when(_all_digits(F.left(s, F.lit(8))) & (F.length(s) >= 8), compact(s))
        .when(F.contains(s, F.lit("/")), year_last(s))
        .otherwise(day_month_name(year_last(s)))
    )
    names = {n: i + 1 for i, m in enumerate(MONTHS) for n in (m, m[:3])} | {"sept": 9}
    number = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])

    def made(a: Column) -> Column:
        # Inside a lambda a failed cast costs an exception, also of a ``try_cast``: text that
        # is empty or no number is null before it.
        def part(i: int) -> Column:
            text = F.get(a, F.lit(i))
            return F.when((text != "") & _all_digits(text), text).try_cast("int")

        month = F.coalesce(part(1), F.try_element_at(number, F.lower(F.get(a, F.lit(1)))))
        half = F.lower(F.get(a, F.lit(6)))
        hour = F.coalesce(part(3), F.lit(0))
        hour = F.when(half == "", hour).when(
            hour.between(1, 12), hour % 12 + F.when(half == "pm", 12).otherwise(0)
        )
        second = F.coalesce(F.nullif(F.get(a, F.lit(5)), F.lit("")).try_cast("decimal(16,6)"), F.lit(0).cast("decimal(16,6)"))
        return F.when(
            second < 60, F.try_make_timestamp_ntz(part(0), month, part(2), hour, F.coalesce(part(4), F.lit(0)), second)
        )

    return F.get(F.transform(F.array(F.split(s, r"\|")), made), F.lit(0))


def layout_counts(df: DataFrame, column: str) -> DataFrame:
    """One row: how many values of a text column hold numbers with the year last
    that can only be read day first (``n_day_first``) or month first
    (``n_month_first``), and how many both ways or neither way (``n_open``).

    Counts of parts of a column add up to those of the whole, so they may be
    kept and merged (``sum`` by name) as more of the column arrives.
    """
    text = F.trim(F.col(column).cast("string"))
    first, second = (F.nullif(F.regexp_extract(text, _YEAR_LAST, i), F.lit("")).try_cast("int") for i in (1, 3))
    return df.select(first.alias("a"), second.alias("b")).agg(
        F.count_if((F.col("a") > 12) & F.col("b").between(1, 12)).alias("n_day_first"),
        F.count_if((F.col("b") > 12) & F.col("a").between(1, 12)).alias("n_month_first"),
        F.count_if(F.col("a").isNotNull() & ((F.col("a") > 12) == (F.col("b") > 12))).alias("n_open"),
    )


def day_first_of(counts: DataFrame) -> Column:
    """The one layout of a column, from its (or the sum of its parts') counts.

    Day first if more values demand it than demand the other; month first
    otherwise, also where nothing decides.  A scalar subquery: it is evaluated
    once, before the values are parsed.
    """
    total = counts.agg(F.sum("n_day_first").alias("d"), F.sum("n_month_first").alias("m"))
    return total.select(F.coalesce(F.col("d") > F.col("m"), F.lit(False))).scalar()


def coerce_date(c: str | Column, source_type: T.DataType | None = None, day_first: bool | Column = False) -> Column:
    """C5 for Expiry_Date: coerce, then keep the date part."""
    if isinstance(source_type, T.DateType):
        return _col(c)
    return coerce_timestamp(c, source_type, day_first).cast("date")


_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def coerce_quantity(c: str | Column, source_type: T.DataType | None = None) -> Column:
    """C6 (value): to a number, null if unparsable or NaN; rounded to int."""
    if isinstance(source_type, _INTEGERS):
        return _col(c).try_cast("int")
    q = _col(c).cast("string").try_cast("double")
    return F.when(q.isNotNull() & ~F.isnan(q), F.round(q).try_cast("int"))


def positive_quantity(c: str | Column, source_type: T.DataType | None = None) -> Column:
    """C6 (predicate): the value parses, is not NaN and is > 0.

    Spark orders NaN above every number, so ``'nan' > 0`` would be true
    without the explicit ``isnan`` guard.  On an integer column the plain
    comparison is kept, which reaches the scan as a pushed filter.
    """
    if isinstance(source_type, _INTEGERS):
        return _col(c) > 0
    q = _col(c).cast("string").try_cast("double")
    return q.isNotNull() & ~F.isnan(q) & (q > 0)
