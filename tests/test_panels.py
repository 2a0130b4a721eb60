"""All panels from one scan a table, and kept up to date by deltas."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from larder.operators import changes as CH
from larder.operators import metrics as M
from larder.operators import panels as PA
from larder.schemas import SCHEMAS

AS_OF = dt.date(2025, 1, 6)


def tables(spark, seed=1):
    rng = random.Random(seed)
    pick = lambda n: rng.choice([None, *range(1, n + 3)])
    rows = {
        "providers": [(k, f"p{k % 5}", rng.choice(["a", "b", None]), None, rng.choice(["x", "y", None]), None) for k in range(1, 9)],
        "receivers": [(k, f"r{k % 4}", "t", "x", None) for k in range(1, 9)],
        "food_listings": [
            (k, rng.choice(["f", "g", None]), rng.choice([None, 1, 5, 9]), rng.choice([None, dt.date(2025, 1, k)]), pick(8), None, None,
             rng.choice(["v", "n", None]), rng.choice(["l", "d", None])) for k in range(1, 25)
        ],
        # Listing 3 holds a third of the claims.
        "claims": [(k, rng.choice([3, pick(24), pick(24)]), pick(8), rng.choice(["Completed", "Pending", None]), None) for k in range(1, 200)],
    }
    return {t: spark.createDataFrame(r, SCHEMAS[t]) for t, r in rows.items()}


def single(t):
    lst, prov, rec, cl = t["food_listings"], t["providers"], t["receivers"], t["claims"]
    return {
        "volume_by_provider_type": M.volume_by_provider_type(lst, prov),
        "avg_quantity_by_provider_type": M.avg_quantity_by_provider_type(lst, prov),
        "most_active_providers": M.most_active_providers(lst, prov),
        "quantity_per_provider": M.quantity_per_provider(lst, prov),
        "top_city_by_listings": M.top_city_by_listings(lst, prov),
        "listings_by_food_type": M.listings_by_food_type(lst),
        "available_quantity": M.available_quantity(lst, AS_OF),
        "claims_by_provider_city": M.claims_by_provider_city(cl, lst, prov),
        "claims_per_item": M.claims_per_item(cl, lst),
        "claims_by_meal_type": M.claims_by_meal_type(cl, lst),
        "successful_claims_by_provider": M.successful_claims_by_provider(cl, lst, prov),
        "claim_status_share": M.claim_status_share(cl),
        "avg_claimed_per_receiver": M.avg_claimed_per_receiver(cl, lst, rec),
        "claims_per_receiver": M.claims_per_receiver(cl, rec),
        "potential_wastage": M.potential_wastage(cl, lst),
    }


def check(told, t):
    want = single(t)
    assert set(told) == set(want)
    for name, df in told.items():
        assert df.columns == want[name].columns, name
        assert sorted(map(repr, df.collect())) == sorted(map(repr, want[name].collect())), name


def sets(t):
    return PA.listing_sets(t["food_listings"]).checkpoint(), PA.claim_sets(t["claims"]).checkpoint()


def test_every_panel_is_that_of_its_single_query(spark):
    t = tables(spark)
    check(PA.panels(*sets(t), t["providers"], t["receivers"], AS_OF), t)
    empty = {n: df.limit(0) for n, df in t.items()}
    check(PA.panels(*sets(empty), empty["providers"], empty["receivers"], AS_OF), empty)


def test_one_scan_a_table(spark, tmp_path):
    t = tables(spark)
    for n in ("food_listings", "claims"):
        t[n].write.parquet(str(tmp_path / n))
        t[n] = spark.read.parquet(str(tmp_path / n))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    for df in (PA.listing_sets(t["food_listings"]), PA.claim_sets(t["claims"])):
        assert len(re.findall(r"Relation \[", plan(df))) == 1 and "Expand" in plan(df)
    told = PA.panels(*sets(t), t["providers"], t["receivers"], AS_OF)
    assert not any("parquet" in plan(df) for df in told.values())
    check(told, t)


@pytest.mark.parametrize("seed", [1, 2])
def test_panels_are_kept_by_deltas(spark, seed):
    t = tables(spark, seed)
    listing, claim = sets(t)
    # A batch on claims: only changed rows are counted.
    batch = spark.createDataFrame(
        [("U", 1, 5, ["Status"], None, None, "Completed"), ("U", 2, 6, ["Food_ID", "Receiver_ID"], 4, None, None), ("D", 3, 7, [], None, None, None),
         ("D", 4, 900, [], None, None, None), ("I", 5, 500, [], 3, 2, "Pending"), ("I", 6, 8, [], 3, 2, "taken"), ("I", 7, None, [], None, 1, None)],
        "op string, seq long, Claim_ID long, `set` array<string>, Food_ID long, Receiver_ID long, Status string",
    )
    keys = batch.where("Claim_ID is not null").select("Claim_ID").distinct()
    before = t["claims"].join(keys, "Claim_ID", "left_semi").select(*t["claims"].columns)
    high = t["claims"].agg(F.max("Claim_ID"))
    after = CH.apply_changes({"claims": before}, "claims", batch, high)["claims"]
    claim = PA.merge(claim, PA.claim_sets(PA.signed(before, after))).checkpoint()
    t["claims"] = CH.apply_changes({"claims": t["claims"]}, "claims", batch)["claims"].checkpoint()
    check(PA.panels(listing, claim, t["providers"], t["receivers"], AS_OF), t)

    # Listings go and take their claims along; a receiver goes and leaves them.
    dead = spark.createDataFrame([(3,), (4,), (99,)], "k long")
    old = t["food_listings"].join(dead, F.col("Food_ID") == F.col("k"), "left_semi")
    listing = PA.merge(listing, PA.listing_sets(PA.signed(old, old.limit(0)))).checkpoint()
    delta = PA.claims_without_listings(claim, dead)
    assert "claims" not in delta._jdf.queryExecution().optimizedPlan().toString()
    claim = PA.merge(claim, delta).checkpoint()
    gone = spark.createDataFrame([(2,), (5,)], "k long")
    claim = PA.merge(claim, PA.claims_without_receivers(claim, gone)).checkpoint()
    t = CH.delete_rows(t, "food_listings", dead)
    t = {n: df.checkpoint() for n, df in CH.delete_rows(t, "receivers", gone).items()}
    check(PA.panels(listing, claim, t["providers"], t["receivers"], AS_OF), t)
    # The stored sets are those of a new count.
    for stored, fresh in ((listing, PA.listing_sets(t["food_listings"])), (claim, PA.claim_sets(t["claims"]))):
        assert sorted(map(repr, stored.select(*fresh.columns).collect())) == sorted(map(repr, fresh.collect()))
