"""Exact decimal rounding of ratios of non-negative integers.

The original queries round decimal results: ``ROUND(AVG(int_col), 2)`` and
``ROUND(COUNT(*) * 100.0 / n, 2)``.  In the original database both the
average and the division are exact DECIMAL operations whose result carries a
fixed number of extra fraction digits (the division precision increment, 4 by
default) and is rounded half up at that scale; ``ROUND`` then rounds half up
again to 2 places.  Rounding the double ``avg`` instead can land on the wrong
side of a ...5 boundary, so the value is computed in integer arithmetic:

    q = floor((2 * 10^e * s + n) / (2 * n))        # s / n half-up at e digits
    r = floor((2 * q + 10^(e-p)) / (2 * 10^(e-p)))  # then half-up at p digits

with decimal division (exact) and one final division as a double.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: extra fraction digits of a DECIMAL division ----------------
DIV_PRECISION_INCREMENT = 4
AVG_INT_SCALE = 0 + DIV_PRECISION_INCREMENT  # AVG of an INT column
PERCENT_SCALE = 1 + DIV_PRECISION_INCREMENT  # COUNT(*) * 100.0 (scale 1) / COUNT(*)


def _dec(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def _half_up_div(num: Column, den: Column) -> Column:
    """floor((2 * num + den) / (2 * den)) for non-negative num, positive den."""
    two = F.lit(2).cast("decimal(38,0)")
    return F.floor((two * num + den) / (two * den)).cast("decimal(38,0)")


def ratio_half_up(numerator: Column, denominator: Column, places: int = 2,
                  exact_places: int | None = None) -> Column:
    """``numerator / denominator`` rounded half up to ``places``, as a double.

    With ``exact_places`` the quotient is first rounded half up to that many
    digits, as the DECIMAL division of the original does.  Null when the
    denominator is null or zero (the empty-group average).
    """
    exact_places = places if exact_places is None else exact_places
    num, den = _dec(numerator), _dec(denominator)
    q = _half_up_div(F.lit(10**exact_places).cast("decimal(38,0)") * num, den)
    step = F.lit(10 ** (exact_places - places)).cast("decimal(38,0)")
    r = _half_up_div(q, step)
    return F.when(den > 0, r.cast("bigint").cast("double") / F.lit(float(10**places)))


def avg_round(total: Column, count: Column, places: int = 2) -> Column:
    """``ROUND(AVG(int_col), places)`` from the column's sum and count."""
    return ratio_half_up(total, count, places, AVG_INT_SCALE)


def percent_round(part: Column, whole: Column, places: int = 2) -> Column:
    """``ROUND(part * 100.0 / whole, places)`` for counts."""
    return ratio_half_up(part * F.lit(100), whole, places, PERCENT_SCALE)
