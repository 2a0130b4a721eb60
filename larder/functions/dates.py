"""The report date parameter."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_of_col(as_of=None) -> Column:
    """``as_of`` as a date column: a date, an ISO string or a Column; None
    means today (the original queries use the database's current date)."""
    if as_of is None:
        return F.current_date()
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, str):
        as_of = dt.date.fromisoformat(as_of)
    return F.lit(as_of)
