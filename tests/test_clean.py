"""Cleaning pipelines on raw string tables (FIXTURES section 2)."""

import datetime as dt

from larder.operators import clean as CL
from larder.operators import profile as PR


def raw(spark, cols, rows):
    return spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in cols))


LCOLS = ["Food_ID", "Food_Name", "Quantity", "Expiry_Date", "Provider_ID", "Provider_Type", "Location",
         "Food_Type", "Meal_Type"]


def test_listing_quantity_and_title(spark):
    rows = [
        ("1", " bread ", "nan", "3/5/2025", "1", "restaurant", "x", "non-vegetarian", "breakfast"),
        ("2", "soup", "3", "2025-03-05", "1.0", "grocery store", "o'neil", "vegan", "lunch"),
        ("3", "rice", "0", "2025-13-01", "1", "a", "b", "c", "d"),
        ("4", "milk", "-1", "x", "1", "a", "b", "c", "d"),
        ("5", "tea", "x", "x", "1", "a", "b", "c", "d"),
        ("6", "\tpie  ", "2", "x", None, "3rd", "b", "c", "d"),
    ]
    out = {r.Food_ID: r for r in CL.clean_listings(raw(spark, LCOLS, rows)).collect()}
    assert sorted(out) == [2, 6]
    assert out[2].Food_Name == "Soup" and out[2].Location == "O'Neil" and out[2].Provider_Type == "Grocery Store"
    assert out[2].Expiry_Date == dt.date(2025, 3, 5) and out[2].Provider_ID == 1 and out[2].Quantity == 3
    assert out[6].Food_Name == "Pie" and out[6].Provider_Type == "3Rd" and out[6].Expiry_Date is None
    assert out[6].Provider_ID is None


def test_listing_dates(spark):
    rows = [(str(i), "n", "1", d, "1", "a", "b", "c", "d")
            for i, d in enumerate(["3/5/2025 5:26", "2025-03-05 10:11:12", "2025-13-01", "x", None])]
    got = {r.Food_ID: r.Expiry_Date for r in CL.clean_listings(raw(spark, LCOLS, rows)).collect()}
    assert got == {0: dt.date(2025, 3, 5), 1: dt.date(2025, 3, 5), 2: None, 3: None, 4: None}


CCOLS = ["Claim_ID", "Food_ID", "Receiver_ID", "Status", "Timestamp"]


def test_claims_dedupe_after_title_and_filters(spark):
    rows = [
        ("1", "5", "7", "pending ", "3/5/2025 5:26"),
        ("1", "5", "7", "Pending", "2025-03-05 05:26:00"),
        ("2", "0", "7", "Completed", "2025-03-05"),
        ("3", None, "7", "Completed", "2025-03-05"),
        ("4", "5", "7", "Completed", "bad"),
        ("5", "5", "7", "cancelled", "2025-03-06"),
    ]
    got = sorted(tuple(r) for r in CL.clean_claims(raw(spark, CCOLS, rows)).collect())
    assert got == [
        (1, 5, 7, "Pending", dt.datetime(2025, 3, 5, 5, 26)),
        (5, 5, 7, "Cancelled", dt.datetime(2025, 3, 6)),
    ]


PCOLS = ["Provider_ID", "Name", "Type", "Address", "City", "Contact"]


def test_providers(spark):
    rows = [("1", "Acme,  Foods-Inc", "Restaurant", "12-B Main,\nSt", " New\r\nYork ", "+1-555x12"),
            ("2", None, None, None, None, "abc")]
    got = {r.Provider_ID: r for r in CL.clean_providers(raw(spark, PCOLS, rows)).collect()}
    assert (got[1].Name, got[1].Address, got[1].City, got[1].Contact) == ("Acme Foods Inc", "12-B Main, St", "New York", "155512")
    assert got[2].Name is None and got[2].Contact == ""


def test_profiles(spark):
    rows = [("1", None, "x", None, "c", None), ("2", "n", None, None, "c", "1")]
    df = raw(spark, PCOLS, rows)
    assert tuple(PR.table_shape(df).collect()[0]) == (2, 6)
    nulls = {r.column_name: r.null_count for r in PR.null_profile(df).collect()}
    assert nulls == {"Provider_ID": 0, "Name": 1, "Type": 1, "Address": 2, "City": 0, "Contact": 1}
    prof = {r.column_name: (r.non_null_count, r.data_type) for r in PR.column_profile(df).collect()}
    assert prof["Address"] == (0, "string")
    nan_df = spark.createDataFrame([(float("nan"),), (None,), (1.0,)], "x double")
    assert PR.null_profile(nan_df).collect()[0].null_count == 2


def test_lenient_keys(spark):
    from larder.functions.coerce import try_key

    vals = ["9007199254740993", "3.0", " 7 ", "x", "nan", "2.5", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, v string")
    got = [r.k for r in df.select("i", try_key("v").alias("k")).orderBy("i").collect()]
    assert got == [9007199254740993, 3, 7, None, None, None, None]
