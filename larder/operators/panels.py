"""The aggregate panels (G4-G20) from one scan a table, kept up to date by deltas.

``listing_sets`` and ``claim_sets`` read their table once and count it by several
keys side by side (GROUPING SETS, combined in each task before the shuffle).
``panels`` derives every panel from these two results and the small sides; it
reads neither table again.

All measures are sums, so changed rows are counted like rows, with a weight: -1
as they were, +1 as they are (``signed``).  ``merge`` adds such deltas to stored
sets and drops groups that have no rows left.  What a deleted listing or
receiver does to its claims follows from the stored sets alone
(``claims_without_listings``, ``claims_without_receivers``): the claims are not read.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.dates import as_of_col
from larder.functions.rounding import avg_round, percent_round
from larder.operators.metrics import _top, _with_provider

WEIGHT = "_weight"
#: Name of each set and the keys that it groups by.
LISTING_SETS = {
    "listing": ("Food_ID", "Quantity", "Provider_ID", "Food_Name", "Meal_Type"),
    "provider": ("Provider_ID",),
    "food type": ("Food_Type",),
    "expiry": ("Expiry_Date",),
}
CLAIM_SETS = {
    "listing, receiver": ("Food_ID", "Receiver_ID"),
    "listing, status": ("Food_ID", "Status"),
    "receiver": ("Receiver_ID",),
    "status": ("Status",),
}


def _grouped(rows: DataFrame, sets: dict[str, tuple[str, ...]], measures: dict[str, Column]) -> DataFrame:
    keys = list(dict.fromkeys(c for s in sets.values() for c in s))
    if WEIGHT not in rows.columns:
        rows = rows.withColumn(WEIGHT, F.lit(1).cast("bigint"))
    # A bit a key, set where the key is not grouped by: it names the set.
    number = {sum((c not in s) << (len(keys) - 1 - i) for i, c in enumerate(keys)): name for name, s in sets.items()}
    name = F.lit(None).cast("string")
    for bits, label in number.items():
        name = F.when(F.col("_bits") == bits, label).otherwise(name)
    # Measures may use columns that are keys of some set: they are copied first.
    copied = {c: f"_of_{c}" for c in keys}
    rows = rows.select("*", *[F.col(c).alias(n) for c, n in copied.items()])
    told = rows.groupingSets([tuple(F.col(c) for c in s) for s in sets.values()], *keys).agg(
        F.grouping_id().alias("_bits"), *[F.sum(F.col(WEIGHT) * m).cast("bigint").alias(n) for n, m in measures.items()]
    )
    return told.select(name.alias("set"), *keys, *measures)


def _one(present: Column) -> Column:
    return F.when(present, 1).otherwise(0)


def listing_sets(listings: DataFrame) -> DataFrame:
    """(set, keys, n_rows, n_ids, q_sum, q_cnt) of listings, each with an optional weight."""
    q = F.col("_of_Quantity")
    return _grouped(listings, LISTING_SETS, {
        "n_rows": F.lit(1), "n_ids": _one(F.col("_of_Food_ID").isNotNull()), "q_sum": F.coalesce(q, F.lit(0)).cast("bigint"), "q_cnt": _one(q.isNotNull()),
    })


def claim_sets(claims: DataFrame) -> DataFrame:
    """(set, keys, n_rows, n_ids) of claims, each with an optional weight."""
    return _grouped(claims, CLAIM_SETS, {"n_rows": F.lit(1), "n_ids": _one(F.col("Claim_ID").isNotNull())})


def signed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Changed rows as they were and as they are, weighted -1 and +1."""
    return before.withColumn(WEIGHT, F.lit(-1).cast("bigint")).unionByName(after.withColumn(WEIGHT, F.lit(1).cast("bigint")))


def merge(stored: DataFrame, *deltas: DataFrame) -> DataFrame:
    """Stored sets plus deltas; groups without rows go."""
    every = stored
    for delta in deltas:
        every = every.unionByName(delta)
    measures = [c for c in stored.columns if c.startswith(("n_", "q_"))]
    keys = [c for c in stored.columns if c not in measures]
    return every.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in measures]).where("n_rows <> 0")


def _cells(stored: DataFrame, name: str) -> DataFrame:
    return stored.where(F.col("set") == name)


def _empty_keys(rows: DataFrame, name: str, stored: DataFrame, **keys: Column) -> DataFrame:
    none = {c: F.lit(None).cast(stored.schema[c].dataType) for c in stored.columns}
    measures = [c for c in stored.columns if c.startswith(("n_", "q_"))]
    return rows.select(F.lit(name).alias("set"), *[
        keys.get(c, none[c]).alias(c) for c in stored.columns if c != "set" and c not in measures
    ], *measures)


def claims_without_listings(stored: DataFrame, dead: DataFrame) -> DataFrame:
    """Delta of ``claim_sets`` where the listings ``dead`` (one column of keys) take their claims along."""
    dead = dead.select(F.col(dead.columns[0]).alias("_dead")).distinct()
    out = None
    for name, coarse in (("listing, receiver", "Receiver_ID"), ("listing, status", "Status")):
        hit = _cells(stored, name).join(dead, F.col("Food_ID") == F.col("_dead"), "left_semi")
        gone = hit.select(*[(-F.col(c)).alias(c) if c.startswith("n_") else F.col(c) for c in stored.columns])
        label = "receiver" if coarse == "Receiver_ID" else "status"
        both = gone.unionByName(_empty_keys(gone, label, stored, **{coarse: F.col(coarse)}))
        out = both if out is None else out.unionByName(both)
    return out


def claims_without_receivers(stored: DataFrame, dead: DataFrame) -> DataFrame:
    """Delta of ``claim_sets`` where the receivers ``dead`` leave their claims without one."""
    dead = dead.select(F.col(dead.columns[0]).alias("_dead")).distinct()
    hit = stored.where(F.col("set").isin("listing, receiver", "receiver")).join(dead, F.col("Receiver_ID") == F.col("_dead"), "left_semi")
    gone = hit.select(*[(-F.col(c)).alias(c) if c.startswith("n_") else F.col(c) for c in stored.columns])
    return gone.unionByName(hit.withColumn("Receiver_ID", F.lit(None).cast("bigint")).select(*stored.columns))


def panels(
    listing: DataFrame, claim: DataFrame, providers: DataFrame, receivers: DataFrame, as_of: dt.date | None = None, status: str = "Completed"
) -> dict[str, DataFrame]:
    """Every panel over listings and claims, with the columns of the single query of its name."""
    per_provider = _cells(listing, "provider").where("Provider_ID is not null").select("Provider_ID", "n_ids", "q_sum", "q_cnt")
    # A sum over no quantity is null, as SUM has it.
    with_name = _with_provider(per_provider, providers, "Name", "Type", "City").withColumn("q_sum", F.when(F.col("q_cnt") > 0, F.col("q_sum")))
    by_expiry = _cells(listing, "expiry")
    whole = by_expiry.agg(F.sum("q_sum").alias("s"), F.sum("q_cnt").alias("c")).select(F.when(F.col("c") > 0, F.col("s")).alias("donated"))
    items = _cells(listing, "listing").select(F.col("Food_ID").alias("_fid"), "Quantity", "Provider_ID", "Food_Name", "Meal_Type", F.col("n_rows").alias("times"))
    of_item = _cells(claim, "listing, status").where("Food_ID is not null").groupBy("Food_ID").agg(
        F.sum("n_rows").alias("n"), F.sum(F.when(F.col("Status") == status, F.col("n_rows"))).alias("done")
    )
    claimed = of_item.join(items, F.col("Food_ID") == F.col("_fid")).select(
        "Quantity", "Provider_ID", "Food_Name", "Meal_Type", (F.col("n") * F.col("times")).alias("n"), (F.col("done") * F.col("times")).alias("done")
    )
    by_type = with_name.groupBy(F.col("Type").alias("Provider_Type"))
    by_city = _with_provider(claimed.groupBy("Provider_ID").agg(F.sum("n").alias("n")), providers, "City")
    done = _with_provider(claimed.where("Provider_ID is not null and done is not null").groupBy("Provider_ID").agg(F.sum("done").alias("n")), providers, "Name")
    quantity = claimed.select(F.sum(F.col("n") * F.col("Quantity")).cast("bigint").alias("claimed"))
    statuses = _cells(claim, "status").select("Status", F.col("n_rows").alias("Total_Claims"))
    n_claims = statuses.select(F.sum("Total_Claims")).scalar()
    cells = _cells(claim, "listing, receiver").where("Food_ID is not null and Receiver_ID is not null")
    taken = cells.join(items, F.col("Food_ID") == F.col("_fid")).groupBy("Receiver_ID").agg(
        F.sum(F.col("n_rows") * F.col("times") * F.col("Quantity")).alias("s"), F.sum(F.when(F.col("Quantity").isNotNull(), F.col("n_rows") * F.col("times"))).alias("c")
    )
    named = receivers.select(F.col("Receiver_ID").alias("_rid"), F.col("Name").alias("Receiver_Name"))
    per_receiver = _cells(claim, "receiver").where("Receiver_ID is not null")
    food_types = _cells(listing, "food type").select("Food_Type", F.col("n_ids").alias("Total_Listings"))
    return {
        "volume_by_provider_type": by_type.agg(F.sum("q_sum").cast("bigint").alias("Total_Quantity_Donated")),
        "avg_quantity_by_provider_type": by_type.agg(avg_round(F.sum("q_sum"), F.sum("q_cnt")).alias("Avg_Quantity")),
        "most_active_providers": _top(
            with_name.select("Provider_ID", F.col("Name").alias("Provider_Name"), F.col("n_ids").alias("Total_Donations")), 10,
            F.col("Total_Donations").desc(), F.col("Provider_ID").asc(),
        ).drop("Provider_ID"),
        "quantity_per_provider": with_name.select(F.col("Name").alias("Provider_Name"), F.col("q_sum").alias("Total_Quantity")),
        "top_city_by_listings": _top(
            with_name.groupBy("City").agg(F.sum("n_ids").cast("bigint").alias("Total_FoodListings")), 1,
            F.col("Total_FoodListings").desc(), F.col("City").asc_nulls_first(),
        ),
        "listings_by_food_type": food_types,
        "available_quantity": by_expiry.where(F.col("Expiry_Date") >= as_of_col(as_of)).agg(
            F.when(F.sum("q_cnt") > 0, F.sum("q_sum")).cast("bigint").alias("Total_Quantity_Available")
        ),
        "claims_by_provider_city": by_city.groupBy("City").agg(F.sum("n").cast("bigint").alias("Total_Claims")),
        "claims_per_item": claimed.groupBy("Food_Name").agg(F.sum("n").cast("bigint").alias("Total_Claims")),
        "claims_by_meal_type": claimed.groupBy("Meal_Type").agg(F.sum("n").cast("bigint").alias("Total_Claims")),
        "successful_claims_by_provider": _top(
            done.select("Provider_ID", F.col("Name").alias("Provider_Name"), F.col("n").cast("bigint").alias("Successful_Claims")), 10,
            F.col("Successful_Claims").desc(), F.col("Provider_ID").asc(),
        ).drop("Provider_ID"),
        "claim_status_share": statuses.select("Status", "Total_Claims", percent_round(F.col("Total_Claims"), n_claims).alias("Percentage")),
        "avg_claimed_per_receiver": taken.join(named, F.col("Receiver_ID") == F.col("_rid")).select(
            "Receiver_Name", avg_round(F.col("s"), F.coalesce("c", F.lit(0))).alias("Avg_Quantity_Claimed")
        ),
        "claims_per_receiver": per_receiver.join(named, F.col("Receiver_ID") == F.col("_rid")).select("Receiver_Name", F.col("n_ids").alias("Total_Claims")),
        "potential_wastage": whole.select(
            F.col("donated").alias("Total_Donated"), quantity.scalar().alias("Total_Claimed"), (F.col("donated") - quantity.scalar()).alias("Potential_Wastage")
        ),
    }


def long_form(told: dict[str, DataFrame]) -> DataFrame:
    """(panel, measure, label, value) of all panels: a row a number."""
    out = None
    for name, df in told.items():
        numbers = [f.name for f in df.schema.fields if f.dataType.simpleString() != "string"]
        labels = [c for c in df.columns if c not in numbers]
        label = F.col(labels[0]) if labels else F.lit(None).cast("string")
        values = F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in numbers])
        rows = df.select(F.lit(name).alias("panel"), label.alias("label"), F.explode(values).alias("v")).select("panel", "v.measure", "label", "v.value")
        out = rows if out is None else out.unionByName(rows)
    return out
