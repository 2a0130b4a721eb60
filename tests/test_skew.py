"""A listing holding a third of all claims: results stay exact, and the plan
combines the hot key map-side before any join."""

import datetime as dt

from pyspark.sql import functions as F

from builders import sample
from larder.operators import metrics as M
from larder.schemas import SCHEMAS


def _skewed_claims(spark, n=30000):
    ids = spark.range(0, n, 1, 12)
    food = F.when(F.col("id") % 3 == 0, F.lit(100)).otherwise(F.lit(101) + (F.col("id") % 4))
    recv = F.when(F.col("id") % 2 == 0, F.lit(10)).otherwise(F.lit(11) + F.col("id") % 2)
    return ids.select(
        (F.col("id") + 1).alias("Claim_ID"), food.cast("bigint").alias("Food_ID"), recv.cast("bigint").alias("Receiver_ID"),
        F.when(F.col("id") % 5 == 0, "Completed").otherwise("Pending").alias("Status"),
        F.lit(dt.date(1998, 1, 1)).cast("timestamp_ntz").alias("Timestamp"),
    ).select(*[F.col(f.name).cast(f.dataType) for f in SCHEMAS["claims"].fields])


def test_hot_listing_exact(spark):
    t = sample(spark)
    claims = _skewed_claims(spark)
    got = dict((r.Food_Name, r.Total_Claims) for r in M.claims_per_item(claims, t["food_listings"]).collect())
    rows = claims.groupBy("Food_ID").count().collect()
    names = {100: "Bread", 101: "Soup", 102: "Rice", 103: "Milk", 104: "Orphan"}
    brute = {}
    for r in rows:
        brute[names[r.Food_ID]] = brute.get(names[r.Food_ID], 0) + r["count"]
    assert got == brute and got["Bread"] == 10000

    avg = {r.Receiver_Name: r.Avg_Quantity_Claimed
           for r in M.avg_claimed_per_receiver(claims, t["food_listings"], t["receivers"]).collect()}
    qty = {100: 10, 101: 5, 102: 7, 103: 3, 104: 4}
    pdf = claims.select("Food_ID", "Receiver_ID").toPandas()
    pdf["q"] = pdf.Food_ID.map(qty)
    exp = pdf.groupby("Receiver_ID").q.agg(["sum", "count"])
    rname = {10: "Shelter", 11: "Family", 12: "Church"}
    for rid, row in exp.iterrows():
        s, c = int(row["sum"]), int(row["count"])
        assert avg[rname[rid]] == ((200 * s + c) // (2 * c)) / 100


def _plan(df):
    import contextlib
    import io

    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def test_partial_aggregation_before_join(spark):
    t = sample(spark)
    plan = _plan(M.claims_per_item(_skewed_claims(spark), t["food_listings"]))
    # the claims side is combined per Food_ID (partial_count) below the join:
    # deeper operators are printed later in the tree
    lines = plan.splitlines()
    join_line = next(i for i, ln in enumerate(lines) if "Join" in ln)
    partial = [i for i, ln in enumerate(lines) if "partial_count(" in ln]
    assert partial and partial[0] > join_line
