"""Aggregates and top-k reports.

Each function maps DataFrames to a DataFrame; nothing is collected.

Pattern used throughout: aggregate the large side on its own key first
(partial + final hash aggregation, so a hot key is combined map-side), then
join the small per-key result to the keyed dimension, then group by the
reported attribute.  A listing claimed by a third of all receivers therefore
becomes one row before any join sees it.

Grouping keys follow the original queries exactly: where a report groups by
``(ID, Name)`` but shows only the name, two providers with the same name stay
two rows.  Top-k reports break count ties by the grouping key so the cut is
deterministic.
"""

from __future__ import annotations

from pyspark.sql import Window, DataFrame
from pyspark.sql import functions as F

from larder.functions.dates import as_of_col
from larder.functions.rounding import avg_round, percent_round
from larder.operators.joins import claims_per_listing


def _top(df: DataFrame, n: int | None, *order) -> DataFrame:
    df = df.orderBy(*order)
    return df.limit(n) if n is not None else df


# --- G1, G2 ---------------------------------------------------------------

def count_by_city(table: DataFrame, alias: str) -> DataFrame:
    """City, COUNT(*) per city (null city is its own group), count desc."""
    return table.groupBy("City").agg(F.count(F.lit(1)).alias(alias)).orderBy(
        F.col(alias).desc(), F.col("City").asc_nulls_first()
    )


def providers_by_city(providers: DataFrame) -> DataFrame:
    return count_by_city(providers, "Total_Providers")


def receivers_by_city(receivers: DataFrame) -> DataFrame:
    return count_by_city(receivers, "Total_Receivers")


# --- G3 ---------------------------------------------------------------------

def parties_by_city(providers: DataFrame, receivers: DataFrame) -> DataFrame:
    """City, distinct providers, distinct receivers (null-padded union semantics).

    Each side is reduced to one row per city on its own (a single distinct
    count each, no Expand), then the two small results are unioned and
    combined per city.  A city present on one side only gets 0 on the other.
    """
    p = providers.groupBy("City").agg(F.countDistinct("Provider_ID").alias("np"))
    r = receivers.groupBy("City").agg(F.countDistinct("Receiver_ID").alias("nr"))
    both = p.unionByName(r, allowMissingColumns=True)
    return both.groupBy("City").agg(
        F.coalesce(F.sum("np"), F.lit(0)).cast("bigint").alias("Total_Providers"),
        F.coalesce(F.sum("nr"), F.lit(0)).cast("bigint").alias("Total_Receivers"),
    )


# --- G4, G4b, G11 -------------------------------------------------------------

def _listing_totals_per_provider(listings: DataFrame) -> DataFrame:
    return listings.where(F.col("Provider_ID").isNotNull()).groupBy("Provider_ID").agg(
        F.sum("Quantity").alias("q_sum"),
        F.count("Quantity").alias("q_cnt"),
        F.count("Food_ID").alias("n_listings"),
    )


def _with_provider(per_provider: DataFrame, providers: DataFrame, *cols: str) -> DataFrame:
    p = providers.select(F.col("Provider_ID").alias("_pid"), *cols)
    return per_provider.join(p, per_provider.Provider_ID == p._pid, "inner").drop("_pid")


def volume_by_provider_type(listings: DataFrame, providers: DataFrame, n: int | None = None) -> DataFrame:
    """Provider_Type, SUM(Quantity) desc (top ``n`` if given; tie: type)."""
    per = _with_provider(_listing_totals_per_provider(listings), providers, "Type")
    out = per.groupBy(F.col("Type").alias("Provider_Type")).agg(
        F.sum("q_sum").cast("bigint").alias("Total_Quantity_Donated")
    )
    return _top(out, n, F.col("Total_Quantity_Donated").desc_nulls_last(),
                F.col("Provider_Type").asc_nulls_first())


def avg_quantity_by_provider_type(listings: DataFrame, providers: DataFrame) -> DataFrame:
    """Provider_Type, ROUND(AVG(Quantity), 2) with exact decimal rounding."""
    per = _with_provider(_listing_totals_per_provider(listings), providers, "Type")
    return per.groupBy(F.col("Type").alias("Provider_Type")).agg(
        avg_round(F.sum("q_sum"), F.sum("q_cnt")).alias("Avg_Quantity")
    )


# --- G5, G6 -------------------------------------------------------------------

def most_active_providers(listings: DataFrame, providers: DataFrame, n: int | None = 10) -> DataFrame:
    """Provider_Name, COUNT(Food_ID) per provider ID; top ``n`` (tie: ID)."""
    per = _with_provider(_listing_totals_per_provider(listings), providers, "Name")
    out = per.select(
        "Provider_ID", F.col("Name").alias("Provider_Name"),
        F.col("n_listings").alias("Total_Donations"),
    )
    return _top(out, n, F.col("Total_Donations").desc(), F.col("Provider_ID").asc()).drop("Provider_ID")


def quantity_per_provider(listings: DataFrame, providers: DataFrame, alias: str = "Total_Quantity") -> DataFrame:
    """Provider_Name, SUM(Quantity) per provider ID, desc."""
    per = _with_provider(_listing_totals_per_provider(listings), providers, "Name")
    out = per.select(
        "Provider_ID", F.col("Name").alias("Provider_Name"),
        F.col("q_sum").cast("bigint").alias(alias),
    )
    return out.orderBy(F.col(alias).desc_nulls_last(), F.col("Provider_ID").asc()).drop("Provider_ID")


# --- G7, G8, G9, G13, G15 -------------------------------------------------------

def _claims_on_listings(claims: DataFrame, listings: DataFrame, *cols: str, status: str | None = None) -> DataFrame:
    per_food = claims_per_listing(claims, status)
    lst = listings.select(F.col("Food_ID").alias("_fid"), *cols)
    return per_food.join(lst, per_food.Food_ID == lst._fid, "inner").drop("_fid")


def claims_by_provider_city(claims: DataFrame, listings: DataFrame, providers: DataFrame) -> DataFrame:
    """Provider City, number of claims on that provider's listings, desc."""
    per_food = _claims_on_listings(claims, listings, "Provider_ID")
    per_provider = per_food.groupBy("Provider_ID").agg(F.sum("n_claims").alias("n"))
    per = _with_provider(per_provider, providers, "City")
    return per.groupBy("City").agg(F.sum("n").cast("bigint").alias("Total_Claims")).orderBy(
        F.col("Total_Claims").desc(), F.col("City").asc_nulls_first()
    )


def claims_per_item(claims: DataFrame, listings: DataFrame, n: int | None = None,
                    alias: str = "Total_Claims") -> DataFrame:
    """Food_Name, claims per food *name*; top ``n`` (tie: name)."""
    per_food = _claims_on_listings(claims, listings, "Food_Name")
    out = per_food.groupBy("Food_Name").agg(F.sum("n_claims").cast("bigint").alias(alias))
    return _top(out, n, F.col(alias).desc(), F.col("Food_Name").asc_nulls_first())


def top_claimed_items(claims: DataFrame, listings: DataFrame, n: int = 10) -> DataFrame:
    return claims_per_item(claims, listings, n, alias="Claim_Count")


def claims_by_meal_type(claims: DataFrame, listings: DataFrame) -> DataFrame:
    """Meal_Type, number of claims, desc."""
    per_food = _claims_on_listings(claims, listings, "Meal_Type")
    return per_food.groupBy("Meal_Type").agg(F.sum("n_claims").cast("bigint").alias("Total_Claims")).orderBy(
        F.col("Total_Claims").desc(), F.col("Meal_Type").asc_nulls_first()
    )


def successful_claims_by_provider(claims: DataFrame, listings: DataFrame, providers: DataFrame,
                                  n: int | None = 10, status: str = "Completed") -> DataFrame:
    """Provider_Name, completed claims per provider ID; top ``n`` (tie: ID)."""
    per_food = _claims_on_listings(claims, listings, "Provider_ID", status=status)
    per_provider = per_food.where(F.col("Provider_ID").isNotNull()).groupBy("Provider_ID").agg(
        F.sum("n_claims").cast("bigint").alias("Successful_Claims")
    )
    per = _with_provider(per_provider, providers, "Name")
    out = per.select("Provider_ID", F.col("Name").alias("Provider_Name"), "Successful_Claims")
    return _top(out, n, F.col("Successful_Claims").desc(), F.col("Provider_ID").asc()).drop("Provider_ID")


# --- G10 ------------------------------------------------------------------------

def claim_status_share(claims: DataFrame, count_alias: str = "Total_Claims") -> DataFrame:
    """Status, count, percentage of *all* claims (null status included in
    the denominator), rounded as the original DECIMAL arithmetic does.

    The total is the sum over the few status counts, so claims are read once.
    """
    per = claims.groupBy("Status").agg(F.count(F.lit(1)).alias(count_alias))
    per = per.withColumn("_total", F.sum(count_alias).over(Window.partitionBy()))
    return per.select(
        "Status", count_alias,
        percent_round(F.col(count_alias), F.col("_total")).alias("Percentage"),
    )


# --- G12, G16 ---------------------------------------------------------------------

def avg_claimed_per_receiver(claims: DataFrame, listings: DataFrame, receivers: DataFrame) -> DataFrame:
    """Receiver_Name, ROUND(AVG(listing Quantity over the receiver's claims), 2).

    (Receiver, listing) pairs hardly repeat, so combining them first would only
    add a shuffle: claims meet the listings directly (one row per key on that
    side; AQE splits the partition of a hot listing), and each receiver's sum
    and count are combined map-side after the join.
    """
    c = claims.where(F.col("Food_ID").isNotNull() & F.col("Receiver_ID").isNotNull()).select("Receiver_ID", "Food_ID")
    lst = listings.select(F.col("Food_ID").alias("_fid"), "Quantity")
    joined = c.join(lst, c.Food_ID == lst._fid, "inner")
    per_receiver = joined.groupBy("Receiver_ID").agg(
        F.sum("Quantity").alias("s"), F.count("Quantity").alias("c")
    )
    r = receivers.select(F.col("Receiver_ID").alias("_rid"), F.col("Name").alias("Receiver_Name"))
    out = per_receiver.join(r, per_receiver.Receiver_ID == r._rid, "inner")
    return out.select(
        "Receiver_ID", "Receiver_Name", avg_round(F.col("s"), F.col("c")).alias("Avg_Quantity_Claimed")
    ).orderBy(F.col("Avg_Quantity_Claimed").desc_nulls_last(), F.col("Receiver_ID").asc()).drop("Receiver_ID")


def claims_per_receiver(claims: DataFrame, receivers: DataFrame) -> DataFrame:
    """Receiver_Name, COUNT(Claim_ID) per receiver ID, desc."""
    per = claims.where(F.col("Receiver_ID").isNotNull()).groupBy("Receiver_ID").agg(
        F.count("Claim_ID").alias("Total_Claims")
    )
    r = receivers.select(F.col("Receiver_ID").alias("_rid"), F.col("Name").alias("Receiver_Name"))
    out = per.join(r, per.Receiver_ID == r._rid, "inner")
    return out.select("Receiver_ID", "Receiver_Name", "Total_Claims").orderBy(
        F.col("Total_Claims").desc(), F.col("Receiver_ID").asc()
    ).drop("Receiver_ID")


# --- G14, G14b, G17 -----------------------------------------------------------------

def listings_by_food_type(listings: DataFrame, n: int | None = None, alias: str = "Total_Listings",
                          count_rows: bool = False) -> DataFrame:
    """Food_Type, number of listings, desc (top ``n``; tie: type).

    ``count_rows`` counts rows (COUNT(*)) instead of non-null Food_IDs.
    """
    counted = F.count(F.lit(1)) if count_rows else F.count("Food_ID")
    out = listings.groupBy("Food_Type").agg(counted.alias(alias))
    return _top(out, n, F.col(alias).desc(), F.col("Food_Type").asc_nulls_first())


def top_city_by_listings(listings: DataFrame, providers: DataFrame, n: int = 1) -> DataFrame:
    """Provider City with the most listings (tie: city)."""
    per = _with_provider(_listing_totals_per_provider(listings), providers, "City")
    out = per.groupBy("City").agg(F.sum("n_listings").cast("bigint").alias("Total_FoodListings"))
    return _top(out, n, F.col("Total_FoodListings").desc(), F.col("City").asc_nulls_first())


# --- G18, G19, G19b, G20 --------------------------------------------------------------

def available_quantity(listings: DataFrame, as_of=None) -> DataFrame:
    """SUM(Quantity) of listings expiring on or after ``as_of`` (null if none)."""
    return listings.where(F.col("Expiry_Date") >= as_of_col(as_of)).agg(
        F.sum("Quantity").cast("bigint").alias("Total_Quantity_Available")
    )


def _claimed_quantity(claims: DataFrame, listings: DataFrame):
    """SUM of the listing Quantity once per claim, as a scalar subquery."""
    per_food = _claims_on_listings(claims, listings, "Quantity")
    return per_food.select(F.sum(F.col("n_claims") * F.col("Quantity")).cast("bigint")).scalar()


def donated_vs_claimed(claims: DataFrame, listings: DataFrame) -> DataFrame:
    """Total_Donated, Total_Claimed, both IFNULL(..., 0)."""
    claimed = _claimed_quantity(claims, listings)
    return listings.agg(F.coalesce(F.sum("Quantity").cast("bigint"), F.lit(0).cast("bigint")).alias("Total_Donated")).select(
        "Total_Donated", F.coalesce(claimed, F.lit(0).cast("bigint")).alias("Total_Claimed")
    )


def potential_wastage(claims: DataFrame, listings: DataFrame) -> DataFrame:
    """Donated, claimed (no IFNULL) and their difference (may be negative)."""
    claimed = _claimed_quantity(claims, listings)
    base = listings.agg(F.sum("Quantity").cast("bigint").alias("Total_Donated"))
    return base.select(
        "Total_Donated", claimed.alias("Total_Claimed"),
        (F.col("Total_Donated") - claimed).alias("Potential_Wastage"),
    )


def overview_totals(providers: DataFrame, receivers: DataFrame, listings: DataFrame) -> DataFrame:
    """providers_count, receivers_count, total_quantity (IFNULL 0)."""
    n_receivers = receivers.select(F.count(F.lit(1))).scalar()
    total_q = listings.select(F.coalesce(F.sum("Quantity").cast("bigint"), F.lit(0).cast("bigint"))).scalar()
    return providers.agg(F.count(F.lit(1)).alias("providers_count")).select(
        "providers_count", n_receivers.alias("receivers_count"), total_q.alias("total_quantity")
    )


# --- G21, G22 ---------------------------------------------------------------------------

def value_counts(df: DataFrame, column: str, label: str) -> DataFrame:
    """pandas ``value_counts``: non-null values of ``column`` with counts, desc."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias(label)).agg(
        F.count(F.lit(1)).alias("Count")
    ).orderBy(F.col("Count").desc(), F.col(label).asc())
