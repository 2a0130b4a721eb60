"""Projections, predicates, searches and ordered previews.

Every predicate is a native Column expression, so equality, range, IN and
NOT NULL filters reach the parquet scan as pushed filters and only the
projected columns are read.  Substring search is case-insensitive ``ilike``
(the tables declare no collation, and the default one of the original
database is case-insensitive); a backslash typed by the user is escaped so it
matches literally, while ``%`` and ``_`` stay wildcards as in plain LIKE.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.dates import as_of_col as _date
from larder.operators.joins import claims_with_names, listings_with_provider


# --- F1, F2 -------------------------------------------------------------------

def eq_filter(df: DataFrame, column: str, value) -> DataFrame:
    """rows whose ``column`` equals ``value`` (null never matches)."""
    return df.where(F.col(column) == F.lit(value))


def like_pattern(text: str) -> str:
    """``%text%`` with backslashes made literal."""
    return "%" + text.replace("\\", "\\\\") + "%"


def contains(column: str | Column, text: str) -> Column:
    """case-insensitive substring match, ``column LIKE '%text%'``."""
    col = F.col(column) if isinstance(column, str) else column
    return col.ilike(like_pattern(text))


def contains_filter(df: DataFrame, column: str, text: str) -> DataFrame:
    return df.where(contains(column, text))


def _all_of(preds: list[Column]) -> Column:
    out = F.lit(True)
    for p in preds:
        out = out & p
    return out


# --- F3a-F3d: parameterised searches ---------------------------------------------

def search_providers(providers: DataFrame, name: str = "", city: str = "", ptype: str = "") -> DataFrame:
    """Providers matching every non-empty input, newest ID first."""
    preds = [contains(c, v) for c, v in (("Name", name), ("City", city), ("Type", ptype)) if v]
    return providers.where(_all_of(preds)).orderBy(F.col("Provider_ID").desc())


def search_receivers(receivers: DataFrame, name: str = "", city: str = "", rtype: str = "") -> DataFrame:
    """Receivers matching every non-empty input, newest ID first."""
    preds = [contains(c, v) for c, v in (("Name", name), ("City", city), ("Type", rtype)) if v]
    return receivers.where(_all_of(preds)).orderBy(F.col("Receiver_ID").desc())


def search_listings(listings: DataFrame, providers: DataFrame, food_name: str = "", food_type: str = "",
                    meal_type: str = "", location: str = "") -> DataFrame:
    """Listings LEFT JOIN providers, filtered, newest Food_ID first.

    The predicates touch listing columns only, so they are applied below the
    join; listings without a provider stay (Provider_Name null).
    """
    preds = [
        contains(c, v)
        for c, v in (("Food_Name", food_name), ("Food_Type", food_type),
                     ("Meal_Type", meal_type), ("Location", location))
        if v
    ]
    joined = listings_with_provider(listings.where(_all_of(preds)), providers, "left")
    return joined.select(
        "Food_ID", "Food_Name", "Food_Type", "Meal_Type", "Quantity", "Expiry_Date",
        "Provider_ID", "Provider_Name", "Location",
    ).orderBy(F.col("Food_ID").desc())


def search_claims(claims: DataFrame, listings: DataFrame, receivers: DataFrame, status: str = "",
                  receiver_name: str = "", food_name: str = "") -> DataFrame:
    """F3d: claims LEFT JOIN listings, receivers; exact status, substring names.

    A name predicate on a joined side removes the null-extended rows, which is
    the outer-to-inner rewrite Catalyst applies by itself.
    """
    c = claims.where(F.col("Status") == F.lit(status)) if status else claims
    joined = claims_with_names(c, listings, receivers, "left")
    preds = []
    if receiver_name:
        preds.append(contains("Receiver_Name", receiver_name))
    if food_name:
        preds.append(contains("Food_Name", food_name))
    return joined.where(_all_of(preds)).select(
        "Claim_ID", "Food_Name", "Receiver_Name", "Status", "Timestamp"
    ).orderBy(F.col("Claim_ID").desc())


def claims_by_receiver_name(claims: DataFrame, listings: DataFrame, receivers: DataFrame, text: str) -> DataFrame:
    """Claim_ID, Food_Name, Receiver for receivers whose name contains ``text``."""
    r = receivers.where(contains("Name", text))
    joined = claims_with_names(claims, listings, r, "inner")
    return joined.select("Claim_ID", "Food_Name", F.col("Receiver_Name").alias("Receiver"))


# --- F4, F5, F13, F14 ---------------------------------------------------------------

FACET_COLUMNS = {"city": "City", "provider": "Provider_Name", "food_type": "Food_Type", "meal_type": "Meal_Type"}


def facet_filter(joined: DataFrame, city: Iterable[str] = (), provider: Iterable[str] = (),
                 food_type: Iterable[str] = (), meal_type: Iterable[str] = ()) -> DataFrame:
    """OR within a facet, AND across facets, empty facet = no filter."""
    preds = []
    for key, values in (("city", city), ("provider", provider), ("food_type", food_type), ("meal_type", meal_type)):
        values = list(values)
        if values:
            preds.append(F.col(FACET_COLUMNS[key]).isin(values))
    return joined.where(_all_of(preds))


def listing_facts(listings: DataFrame, providers: DataFrame) -> DataFrame:
    """The joined listing/provider projection the facets work on."""
    return listings_with_provider(listings, providers, "inner").select(
        "Food_ID", "Food_Name", "Food_Type", "Quantity", "Expiry_Date", "Meal_Type",
        "Provider_Name", "City", "Contact", "Address",
    )


def listing_preview(listings: DataFrame, providers: DataFrame, n: int = 6, **facets) -> DataFrame:
    """first ``n`` facet-filtered listings (by Food_ID)."""
    filtered = facet_filter(listing_facts(listings, providers), **facets)
    return filtered.orderBy("Food_ID").limit(n).drop("Food_ID")


def facet_values(providers: DataFrame, listings: DataFrame) -> DataFrame:
    """(facet, value) for distinct non-null City, Name, Food_Type, Meal_Type."""

    def pairs(df: DataFrame, *columns: str) -> DataFrame:
        each = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in columns])
        return df.select(F.inline(each))

    # One pass per table: a row gives all its facets at once.
    out = pairs(providers, "City", "Name").unionByName(pairs(listings, "Food_Type", "Meal_Type"))
    return out.where(F.col("value").isNotNull()).distinct()


def listings_with_provider_view(listings: DataFrame, providers: DataFrame) -> DataFrame:
    """Food_ID, Food_Name, Quantity, Expiry_Date, Provider_Name, City."""
    return listings_with_provider(listings, providers, "inner").select(
        "Food_ID", "Food_Name", "Quantity", "Expiry_Date", "Provider_Name", "City"
    )


# --- F6-F8, F12: expiry --------------------------------------------------------------

def near_expiry(listings: DataFrame, as_of, days: int, n: int | None = None,
                with_id: bool = False) -> DataFrame:
    """listings expiring in [as_of, as_of + days], soonest first."""
    d = _date(as_of)
    cols = (["Food_ID"] if with_id else []) + ["Food_Name", "Expiry_Date", "Quantity"]
    out = listings.where(F.col("Expiry_Date").between(d, F.date_add(d, days)))
    out = out.orderBy("Expiry_Date", "Food_ID")
    if n is not None:
        out = out.limit(n)
    return out.select(*cols)


def upcoming_expiry(listings: DataFrame, as_of, n: int = 10) -> DataFrame:
    """the ``n`` soonest listings expiring strictly after ``as_of``."""
    d = _date(as_of)
    return listings.where(F.col("Expiry_Date") > d).orderBy("Expiry_Date", "Food_ID").limit(n).select(
        "Food_Name", "Expiry_Date", "Quantity"
    )


def expiry_status_col(as_of, soon_days: int = 7) -> Column:
    d = _date(as_of)
    e = F.col("Expiry_Date")
    return (
        F.when(e < d, F.lit("Expired"))
        .when(e.between(d, F.date_add(d, soon_days)), F.lit("Expiring Soon"))
        .otherwise(F.lit("Safe"))
    )


def expiry_status(listings: DataFrame, as_of, soon_days: int = 7) -> DataFrame:
    """F8: every listing with Expired / Expiring Soon / Safe (null expiry: Safe)."""
    return listings.select(
        "Food_ID", "Food_Name", "Expiry_Date", "Quantity", expiry_status_col(as_of, soon_days).alias("Expiry_Status")
    ).orderBy(F.col("Expiry_Date").asc_nulls_first(), "Food_ID").drop("Food_ID")


def expired_listings(listings: DataFrame, as_of, inclusive_today: bool = False) -> DataFrame:
    """C11: listings already expired at ``as_of`` (optionally counting today)."""
    d = _date(as_of)
    cond = F.col("Expiry_Date") <= d if inclusive_today else F.col("Expiry_Date") < d
    return listings.where(cond)


def distinct_expiry_dates(listings: DataFrame) -> DataFrame:
    """sorted distinct expiry dates (null first)."""
    return listings.select("Expiry_Date").distinct().orderBy(F.col("Expiry_Date").asc_nulls_first())


# --- F9-F11 -------------------------------------------------------------------------

def open_claims(claims: DataFrame, listings: DataFrame, receivers: DataFrame, closed: str = "Completed") -> DataFrame:
    """claims whose status is not ``closed`` (null status excluded), newest first."""
    c = claims.where(F.col("Status") != F.lit(closed))
    joined = claims_with_names(c, listings, receivers, "inner")
    return joined.select("Claim_ID", "Food_Name", F.col("Receiver_Name").alias("Receiver"), "Status").orderBy(
        F.col("Claim_ID").desc()
    )


def contacts_in_city(providers: DataFrame, city: str) -> DataFrame:
    """Provider_Name, Type, Contact, Address of providers in ``city``."""
    return providers.where(F.col("City") == F.lit(city)).select(
        F.col("Name").alias("Provider_Name"), "Type", "Contact", "Address"
    )


def receiver_contacts_in_city(receivers: DataFrame, city: str) -> DataFrame:
    """F10 (receivers): Name, Contact of receivers in ``city``."""
    return receivers.where(F.col("City") == F.lit(city)).select("Name", "Contact")


def provider_directory(providers: DataFrame, n: int = 500) -> DataFrame:
    """Name, City, Contact, Address ordered by name, first ``n``."""
    return providers.orderBy(F.col("Name").asc_nulls_first(), "Provider_ID").limit(n).select(
        "Name", "City", "Contact", "Address"
    )


# --- L1-L3 ----------------------------------------------------------------------------

def latest_rows(df: DataFrame, key: str, n: int = 10) -> DataFrame:
    """L1: top ``n`` rows by primary key descending (a top-k, no full sort)."""
    return df.orderBy(F.col(key).desc()).limit(n)


def latest_claims_by_time(claims: DataFrame, n: int = 5) -> DataFrame:
    """L2: the ``n`` most recent claims (tie: Claim_ID desc)."""
    return claims.orderBy(F.col("Timestamp").desc_nulls_last(), F.col("Claim_ID").desc()).limit(n)


def sample_contacts(providers: DataFrame, n: int = 5) -> DataFrame:
    """L3: Name, City, Contact of the first ``n`` providers by ID."""
    return providers.orderBy("Provider_ID").limit(n).select("Name", "City", "Contact")
