"""Join building blocks.

The listing, provider and receiver tables are keyed (one row per ID); claims
are the fact table.  Two rules keep these joins safe at scale:

1. Aggregate the fact side *before* it meets a dimension whenever the query
   only needs an aggregate (``claims_per_listing``): partial aggregation
   collapses a hot listing map-side, and the join then sees one row per key.
2. Never force a broadcast of a table that grows with the data; Spark's size
   check (``autoBroadcastJoinThreshold``) and AQE pick broadcast or
   sort-merge at run time, and AQE splits a skewed partition of the fact side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def listings_with_provider(listings: DataFrame, providers: DataFrame, how: str = "inner") -> DataFrame:
    """J1 (inner) / J6 (left): listing columns plus Provider_Name, City, Contact, Address."""
    p = providers.select(
        F.col("Provider_ID").alias("_p_id"),
        F.col("Name").alias("Provider_Name"),
        F.col("Type").alias("_p_type"),
        F.col("City"),
        F.col("Contact"),
        F.col("Address"),
    )
    return listings.join(p, listings.Provider_ID == p._p_id, how).drop("_p_id")


def claims_per_listing(claims: DataFrame, status: str | None = None) -> DataFrame:
    """(Food_ID, n_claims): COUNT(Claim_ID) per claimed listing, pre-aggregated.

    ``status`` keeps only claims with that exact status (G15).
    """
    c = claims.where(F.col("Food_ID").isNotNull())
    if status is not None:
        c = c.where(F.col("Status") == F.lit(status))
    return c.groupBy("Food_ID").agg(F.count("Claim_ID").alias("n_claims"))


def claims_with_names(claims: DataFrame, listings: DataFrame, receivers: DataFrame, how: str = "inner") -> DataFrame:
    """J2 (inner) / J7 (left): claim rows with Food_Name and receiver Name.

    Row-level output (every claim is a result row), so there is nothing to
    pre-aggregate; the listing and receiver sides are one row per key.
    """
    f = listings.select(F.col("Food_ID").alias("_f_id"), "Food_Name")
    r = receivers.select(F.col("Receiver_ID").alias("_r_id"), F.col("Name").alias("Receiver_Name"))
    out = claims.join(f, claims.Food_ID == f._f_id, how)
    out = out.join(r, out.Receiver_ID == r._r_id, how)
    return out.drop("_f_id", "_r_id")
