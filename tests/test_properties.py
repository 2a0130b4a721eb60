"""Properties over the driver tables."""

import pytest

from conftest import SF_SMALL
from larder.operators import changes as CH
from larder.operators import clean as CL
from larder.operators import filters as FL
from larder.operators import integrity as IN
from larder.operators import metrics as M
from larder.sources.driver import DriverTables


@pytest.fixture(scope="module")
def t(spark):
    return DriverTables(spark, SF_SMALL)


def test_facet_counts_sum_to_filtered_rows(t):
    facets = {"city": ["NATION_1", "NATION_3"], "meal_type": ["Brand#1", "Brand#2", "Brand#3"]}
    facts = FL.facet_filter(FL.listing_facts(t.food_listings, t.providers), **facets)
    n = facts.where("Food_Type IS NOT NULL").count()
    assert sum(r.Count for r in M.value_counts(facts, "Food_Type", "Food_Type").collect()) == n
    assert sum(r.Count for r in M.value_counts(facts, "Provider_Name", "Provider").collect()) == facts.where(
        "Provider_Name IS NOT NULL").count()


def test_shares_sum_to_100(t):
    rows = M.claim_status_share(t.claims).collect()
    assert abs(sum(r.Percentage for r in rows) - 100) <= 0.005 * len(rows) + 1e-9
    assert sum(r.Total_Claims for r in rows) == t.claims.count()


def test_wastage_identity(t):
    w = M.potential_wastage(t.claims, t.food_listings).collect()[0]
    d = M.donated_vs_claimed(t.claims, t.food_listings).collect()[0]
    assert w.Potential_Wastage == w.Total_Donated - w.Total_Claimed
    assert (d.Total_Donated, d.Total_Claimed) == (w.Total_Donated, w.Total_Claimed)


def test_cleaning_idempotent(t):
    once = CL.clean_listings(t.food_listings)
    twice = CL.clean_listings(once)
    assert once.exceptAll(twice).count() == 0 and twice.exceptAll(once).count() == 0
    c1 = CL.clean_claims(t.claims)
    assert c1.exceptAll(CL.clean_claims(c1)).count() == 0


def test_deletes_leave_no_dangling_references(t, spark):
    from pyspark.sql import functions as F

    doomed = t.providers.where(F.col("Provider_ID") % 3 == 0).select("Provider_ID")
    out = CH.delete_rows(t.as_dict(), "providers", doomed)
    doomed_l = out["food_listings"].where(F.col("Quantity") > 40).select("Food_ID")
    out = CH.delete_rows(out, "food_listings", doomed_l)
    assert IN.fk_violations(out).count() == 0
    assert out["claims"].count() + t.claims.join(doomed_l, "Food_ID", "left_semi").count() == t.claims.count()
