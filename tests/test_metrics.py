"""Aggregates and top-k on hand-made tables (ties, equal names, orphans)."""

from builders import claims, listings, sample
from larder.operators import metrics as M


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda t: tuple((x is not None, x) for x in t))


def test_equal_names_stay_separate(spark):
    t = sample(spark)
    out = rows(M.most_active_providers(t["food_listings"], t["providers"]))
    assert out == [("Acme", 1), ("Acme", 2), ("Bobs", 1)]
    fac = M.value_counts(t["providers"].withColumnRenamed("Name", "Provider_Name"), "Provider_Name", "Provider")
    assert rows(fac) == [("Acme", 2), ("Bobs", 1)]


def test_top_k_tie_break(spark):
    t = sample(spark)
    top1 = M.most_active_providers(t["food_listings"], t["providers"], n=1).collect()
    assert [tuple(r) for r in top1] == [("Acme", 2)]  # provider 1 beats 2 and 3 on key


def test_orphan_listing_and_totals(spark):
    t = sample(spark)
    vol = rows(M.volume_by_provider_type(t["food_listings"], t["providers"]))
    assert vol == [("Grocery", 7), ("Restaurant", 18)]  # orphan (4) excluded by inner join
    tot = M.donated_vs_claimed(t["claims"], t["food_listings"]).collect()[0]
    # listing 100 claimed twice -> 20, 102 -> 7, 103 -> 3, 104 -> 4; claim with null Food_ID ignored
    assert (tot.Total_Donated, tot.Total_Claimed) == (29, 34)
    w = M.potential_wastage(t["claims"], t["food_listings"]).collect()[0]
    assert w.Potential_Wastage == -5


def test_no_claims(spark):
    t = sample(spark)
    empty = claims(spark, [])
    tot = M.donated_vs_claimed(empty, t["food_listings"]).collect()[0]
    assert tot.Total_Claimed == 0
    w = M.potential_wastage(empty, t["food_listings"]).collect()[0]
    assert w.Total_Claimed is None and w.Potential_Wastage is None


def test_status_share_counts_null_status(spark):
    t = sample(spark)
    out = {r.Status: (r.Total_Claims, r.Percentage) for r in M.claim_status_share(t["claims"]).collect()}
    assert out == {"Completed": (2, 33.33), "Pending": (2, 33.33), "Cancelled": (1, 16.67), None: (1, 16.67)}


def test_exact_half_up_average(spark):
    # quantities 1 and 2 -> 1.5 ; 1,1,2 -> 1.333 ; 0.125 boundary: (1,0,0,0,0,0,0,0) -> 0.125 -> 0.13
    f = listings(spark, [(i, "x", q, None, 1, "T", "M") for i, q in enumerate([1, 0, 0, 0, 0, 0, 0, 0])])
    t = sample(spark)
    out = M.avg_quantity_by_provider_type(f, t["providers"]).collect()
    assert [(r.Provider_Type, r.Avg_Quantity) for r in out] == [("Restaurant", 0.13)]


def test_avg_claimed_per_receiver(spark):
    t = sample(spark)
    out = rows(M.avg_claimed_per_receiver(t["claims"], t["food_listings"], t["receivers"]))
    # receiver 10: listings 100 (10) and 102 (7) -> 8.5 ; 11: 100 -> 10 ; 12: 103 (3), 104 (4) -> 3.5
    assert out == [("Church", 3.5), ("Family", 10.0), ("Shelter", 8.5)]


def test_parties_by_city(spark):
    t = sample(spark)
    out = rows(M.parties_by_city(t["providers"], t["receivers"]).fillna("-", ["City"]))
    assert out == [("-", 1, 0), ("Capital", 0, 1), ("Shelbyville", 1, 0), ("Springfield", 1, 2)]


def test_claims_groupings(spark):
    t = sample(spark)
    assert rows(M.claims_per_item(t["claims"], t["food_listings"])) == [
        ("Bread", 2), ("Milk", 1), ("Orphan", 1), ("Rice", 1)]
    assert rows(M.claims_by_meal_type(t["claims"], t["food_listings"])) == [
        ("Breakfast", 3), ("Dinner", 1), ("Snacks", 1)]
    assert rows(M.successful_claims_by_provider(t["claims"], t["food_listings"], t["providers"])) == [
        ("Acme", 1), ("Bobs", 1)]
    assert rows(M.claims_by_provider_city(t["claims"], t["food_listings"], t["providers"])) == [
        (None, 1), ("Shelbyville", 1), ("Springfield", 2)]
    assert rows(M.claims_per_receiver(t["claims"], t["receivers"])) == [("Church", 2), ("Family", 2), ("Shelter", 2)]


def test_available_and_overview(spark):
    t = sample(spark)
    import datetime as dt
    assert M.available_quantity(t["food_listings"], dt.date(1998, 6, 1)).collect()[0][0] == 20
    assert M.available_quantity(t["food_listings"], dt.date(2000, 1, 1)).collect()[0][0] is None
    o = M.overview_totals(t["providers"], t["receivers"], t["food_listings"]).collect()[0]
    assert tuple(o) == (3, 3, 29)


def test_decimal_double_rounding(spark):
    from pyspark.sql import functions as F

    from larder.functions.rounding import avg_round, percent_round, ratio_half_up

    df = spark.createDataFrame([(22499, 20000, 12344996, 1000000, 1, 3, 0)], "s long, c long, a long, b long, k long, n long, z long")
    r = df.select(
        avg_round(F.col("s"), F.col("c")).alias("avg"),  # 1.12495 -> 1.1250 -> 1.13
        ratio_half_up(F.col("s"), F.col("c")).alias("exact"),  # 1.12495 -> 1.12
        ratio_half_up(F.col("a"), F.col("b"), 2, 5).alias("pct5"),  # 12.344996 -> 12.34500 -> 12.35
        percent_round(F.col("k"), F.col("n")).alias("pct"),  # 33.333.. -> 33.33
        avg_round(F.col("s"), F.col("z")).alias("empty"),
    ).collect()[0]
    assert (r.avg, r.exact, r.pct5, r.pct, r.empty) == (1.13, 1.12, 12.35, 33.33, None)
