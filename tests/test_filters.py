"""Filters, searches and expiry windows."""

import datetime as dt

from builders import sample
from larder.operators import filters as FL

AS_OF = dt.date(1998, 6, 1)


def test_expiry_status_boundaries(spark):
    t = sample(spark)
    got = {r.Food_Name: r.Expiry_Status for r in FL.expiry_status(t["food_listings"], AS_OF).collect()}
    assert got == {"Soup": "Expired", "Bread": "Expiring Soon", "Rice": "Expiring Soon",
                   "Milk": "Safe", "Orphan": "Safe"}


def test_near_and_upcoming(spark):
    t = sample(spark)
    assert [r.Food_Name for r in FL.near_expiry(t["food_listings"], AS_OF, 7).collect()] == ["Bread", "Rice"]
    assert [r.Food_Name for r in FL.upcoming_expiry(t["food_listings"], AS_OF, 10).collect()] == ["Rice", "Milk"]
    assert FL.near_expiry(t["food_listings"], AS_OF, 3, with_id=True).columns[0] == "Food_ID"


def test_search_backslash_and_case(spark):
    t = sample(spark)
    assert FL.search_providers(t["providers"], name="a\\").count() == 0
    got = [r.Provider_ID for r in FL.search_providers(t["providers"], name="acme").collect()]
    assert got == [2, 1]  # case-insensitive, newest first
    assert FL.search_providers(t["providers"], name="acme", city="shelby").count() == 1


def test_search_listings_keeps_orphans(spark):
    t = sample(spark)
    rows = FL.search_listings(t["food_listings"], t["providers"], food_type="grain").collect()
    assert [(r.Food_ID, r.Provider_Name) for r in rows] == [(104, None), (102, "Acme")]


def test_search_claims_left_joins(spark):
    t = sample(spark)
    rows = FL.search_claims(t["claims"], t["food_listings"], t["receivers"]).collect()
    assert len(rows) == 6 and rows[0].Claim_ID == 1005 and rows[0].Food_Name is None
    assert FL.search_claims(t["claims"], t["food_listings"], t["receivers"], food_name="bread").count() == 2


def test_facets(spark):
    t = sample(spark)
    facts = FL.listing_facts(t["food_listings"], t["providers"])
    assert facts.count() == 4  # orphan dropped by the inner join
    assert FL.facet_filter(facts, city=["Springfield"], meal_type=["Breakfast"]).count() == 1
    assert FL.facet_filter(facts, provider=["Acme"]).count() == 3  # both providers named Acme
    assert FL.facet_filter(facts).count() == 4
    vals = {(r.facet, r.value) for r in FL.facet_values(t["providers"], t["food_listings"]).collect()}
    assert ("City", None) not in vals and ("Name", "Acme") in vals


def test_open_claims(spark):
    t = sample(spark)
    got = [(r.Claim_ID, r.Status) for r in FL.open_claims(t["claims"], t["food_listings"], t["receivers"]).collect()]
    assert got == [(1002, "Cancelled"), (1001, "Pending")]  # null status and null food excluded


def test_latest_and_directory(spark):
    t = sample(spark)
    assert [r.Claim_ID for r in FL.latest_rows(t["claims"], "Claim_ID", 2).collect()] == [1005, 1004]
    assert [r.Claim_ID for r in FL.latest_claims_by_time(t["claims"], 1).collect()] == [1005]
    assert [r.Name for r in FL.provider_directory(t["providers"], 2).collect()] == ["Acme", "Acme"]
