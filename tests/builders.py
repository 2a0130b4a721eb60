"""Small hand-made tables for operator tests."""

import datetime as dt

from larder.schemas import SCHEMAS


def D(s):
    return dt.date.fromisoformat(s)


def TS(s):
    return dt.datetime.fromisoformat(s)


def providers(spark, rows):
    # rows: (id, name, type, city)
    return spark.createDataFrame([(i, n, t, None, c, None) for i, n, t, c in rows], SCHEMAS["providers"])


def receivers(spark, rows):
    # rows: (id, name, type, city)
    return spark.createDataFrame([(i, n, t, c, None) for i, n, t, c in rows], SCHEMAS["receivers"])


def listings(spark, rows):
    # rows: (id, name, qty, expiry, provider_id, food_type, meal_type)
    return spark.createDataFrame(
        [(i, n, q, e, p, None, None, ft, mt) for i, n, q, e, p, ft, mt in rows], SCHEMAS["food_listings"]
    )


def claims(spark, rows):
    # rows: (id, food_id, receiver_id, status, ts)
    return spark.createDataFrame(rows, SCHEMAS["claims"])


def sample(spark):
    p = providers(spark, [(1, "Acme", "Restaurant", "Springfield"), (2, "Acme", "Grocery", "Shelbyville"),
                          (3, "Bobs", "Restaurant", None)])
    r = receivers(spark, [(10, "Shelter", "NGO", "Springfield"), (11, "Family", "Individual", "Capital"),
                          (12, "Church", "NGO", "Springfield")])
    f = listings(spark, [
        (100, "Bread", 10, D("1998-06-01"), 1, "Bakery", "Breakfast"),
        (101, "Soup", 5, D("1998-05-31"), 1, "Cooked", "Lunch"),
        (102, "Rice", 7, D("1998-06-08"), 2, "Grain", "Dinner"),
        (103, "Milk", 3, D("1998-06-09"), 3, "Dairy", "Breakfast"),
        (104, "Orphan", 4, None, None, "Grain", "Snacks"),
    ])
    c = claims(spark, [
        (1000, 100, 10, "Completed", TS("1998-01-01 10:00:00")),
        (1001, 100, 11, "Pending", TS("1998-01-02 10:00:00")),
        (1002, 102, 10, "Cancelled", TS("1998-01-03 10:00:00")),
        (1003, 103, 12, "Completed", TS("1998-01-04 10:00:00")),
        (1004, 104, 12, None, TS("1998-01-05 10:00:00")),
        (1005, None, 11, "Pending", TS("1998-01-06 10:00:00")),
    ])
    return {"providers": p, "receivers": r, "food_listings": f, "claims": c}
