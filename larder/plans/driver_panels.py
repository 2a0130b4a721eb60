"""Registered: all panels from one scan a table, and after change batches from deltas alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.operators import changes as CH
from larder.operators import panels as PA
from larder.plans import driver_queries  # noqa: F401 - the single queries' texts
from larder.plans.registry import AS_OF, REGISTRY, register

#: Panel, its label and its numbers; the oracle text of each is that of the single query.
NUMBERS = {
    "volume_by_provider_type": ("Provider_Type", ["Total_Quantity_Donated"]),
    "avg_quantity_by_provider_type": ("Provider_Type", ["Avg_Quantity"]),
    "most_active_providers": ("Provider_Name", ["Total_Donations"]),
    "quantity_per_provider": ("Provider_Name", ["Total_Quantity"]),
    "top_city_by_listings": ("City", ["Total_FoodListings"]),
    "listings_by_food_type": ("Food_Type", ["Total_Listings"]),
    "available_quantity": (None, ["Total_Quantity_Available"]),
    "claims_by_provider_city": ("City", ["Total_Claims"]),
    "claims_per_item": ("Food_Name", ["Total_Claims"]),
    "claims_by_meal_type": ("Meal_Type", ["Total_Claims"]),
    "successful_claims_by_provider": ("Provider_Name", ["Successful_Claims"]),
    "claim_status_share": ("Status", ["Total_Claims", "Percentage"]),
    "avg_claimed_per_receiver": ("Receiver_Name", ["Avg_Quantity_Claimed"]),
    "claims_per_receiver": ("Receiver_Name", ["Total_Claims"]),
    "potential_wastage": (None, ["Total_Donated", "Total_Claimed", "Potential_Wastage"]),
}


def long_sql(tables: str = "") -> str:
    """The single queries' texts one below the other, over ``tables`` if given."""
    return " UNION ALL ".join(
        f"SELECT '{name}' AS panel, '{measure}' AS measure, {label or 'CAST(NULL AS VARCHAR)'} AS label, CAST({measure} AS DOUBLE) AS value "
        f"FROM ({tables}{REGISTRY[name].oracle})"
        for name, (label, measures) in NUMBERS.items() for measure in measures
    )


def written(df: DataFrame) -> DataFrame:
    return df.checkpoint(eager=True)


def sets_of(t) -> tuple[DataFrame, DataFrame]:
    return written(PA.listing_sets(t.food_listings)), written(PA.claim_sets(t.claims))


@register("panels_in_one_pass", long_sql())
def _one_pass(t):
    listing, claim = sets_of(t)
    return PA.long_form(PA.panels(listing, claim, t.providers, t.receivers, AS_OF))


# --- kept up to date -------------------------------------------------------------------

#: New claims lie this far above the claims that they are made of.
N = 10**9


def claim_changes(claims: DataFrame) -> DataFrame:
    """By the key's remainder of 9: 0 completed, 3 moved to no receiver, 4 deleted, 5 entered again for the next listing."""
    none = F.lit(None).cast("bigint")
    turn = F.pmod("Claim_ID", F.lit(9))
    op = F.when(turn.isin(0, 3), "U").when(turn == 4, "D").when(turn == 5, "I")
    names = F.when(turn == 0, F.array(F.lit("Status"))).when(turn == 3, F.array(F.lit("Receiver_ID"))).otherwise(F.array().cast("array<string>"))
    return claims.where(turn.isin(0, 3, 4, 5)).select(
        op.alias("op"), F.col("Claim_ID").alias("seq"), names.alias("set"), F.when(turn == 5, F.col("Claim_ID") + N).otherwise(F.col("Claim_ID")).alias("Claim_ID"),
        F.when(turn == 5, F.col("Food_ID") + 1).alias("Food_ID"), F.when(turn == 3, none).otherwise(F.col("Receiver_ID")).alias("Receiver_ID"),
        F.lit("Completed").alias("Status"),
    )


_CHANGED = f""", changed_listings AS (
  SELECT * REPLACE (CASE WHEN Food_ID % 13 = 1 THEN Quantity + 7 ELSE Quantity END AS Quantity) FROM food_listings WHERE Food_ID % 13 <> 0),
kept_receivers AS (SELECT * FROM receivers WHERE Receiver_ID % 17 <> 0),
own_claims AS (
  SELECT Claim_ID, Food_ID, CASE WHEN Claim_ID % 9 = 3 THEN NULL ELSE Receiver_ID END AS Receiver_ID,
         CASE WHEN Claim_ID % 9 = 0 THEN 'Completed' ELSE Status END AS Status, Timestamp FROM claims WHERE Claim_ID % 9 <> 4
  UNION ALL SELECT Claim_ID + {N}, Food_ID + 1, Receiver_ID, 'Completed', NULL FROM claims WHERE Claim_ID % 9 = 5),
changed_claims AS (
  SELECT Claim_ID, Food_ID, CASE WHEN Receiver_ID % 17 = 0 THEN NULL ELSE Receiver_ID END AS Receiver_ID, Status, Timestamp
  FROM own_claims WHERE coalesce(Food_ID % 13 <> 0, true))
"""
_OVER_CHANGED = (
    "WITH food_listings AS (SELECT * FROM changed_listings), claims AS (SELECT * FROM changed_claims), receivers AS (SELECT * FROM kept_receivers) "
)


def maintained(t) -> tuple[DataFrame, DataFrame]:
    """The stored sets after a batch on claims, one on listings and one on receivers.

    Only changed rows are counted; what the deletes do to other claims comes
    out of the stored sets.
    """
    listing, claim = sets_of(t)
    batch = written(claim_changes(t.claims))
    touched = t.claims.join(batch.select("Claim_ID").distinct(), "Claim_ID", "left_semi").select(*t.claims.columns)
    before = written(touched)
    after = CH.apply_changes({"claims": before}, "claims", batch)["claims"]
    claim = written(PA.merge(claim, PA.claim_sets(PA.signed(before, after))))

    key = F.pmod("Food_ID", F.lit(13))
    old = t.food_listings.where(key.isin(0, 1))
    new = old.where(key == 1).withColumn("Quantity", (F.col("Quantity") + 7).cast("int"))
    listing = written(PA.merge(listing, PA.listing_sets(PA.signed(old, new))))
    claim = written(PA.merge(claim, PA.claims_without_listings(claim, old.where(key == 0).select("Food_ID"))))
    gone = t.receivers.where(F.pmod("Receiver_ID", F.lit(17)) == 0).select("Receiver_ID")
    return listing, written(PA.merge(claim, PA.claims_without_receivers(claim, gone)))


@register("panels_kept_by_deltas", _CHANGED + long_sql(_OVER_CHANGED))
def _kept(t):
    listing, claim = maintained(t)
    left = t.receivers.where(F.pmod("Receiver_ID", F.lit(17)) != 0)
    return PA.long_form(PA.panels(listing, claim, t.providers, left, AS_OF))
