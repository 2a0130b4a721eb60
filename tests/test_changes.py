"""Change application: inserts with dense IDs, updates, deletes, re-keys."""

import datetime as dt

from pyspark.sql import functions as F

from builders import sample
from larder.operators import changes as CH
from larder.operators import integrity as IN


def test_dense_positions_match_brute_force(spark):
    df = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5003).alias("k"), F.col("id"))
    got = {r.k: r._pos for r in CH.dense_positions(df, ["k"]).collect()}
    expected = {k: i + 1 for i, k in enumerate(sorted(got))}
    assert got == expected


def test_insert_assigns_ids_after_max(spark):
    t = sample(spark)
    new = spark.createDataFrame([(2, 101, 10, "Pending"), (1, 100, 11, "Pending")],
                                "seq long, Food_ID long, Receiver_ID long, Status string")
    out = CH.insert_rows(t["claims"], new, "claims", order_cols=["seq"])
    added = {r.Claim_ID: r.Food_ID for r in out.where("Claim_ID > 1005").collect()}
    assert added == {1006: 100, 1007: 101}
    assert out.count() == 8


def test_insert_with_existing_key_is_skipped(spark):
    t = sample(spark)
    new = spark.createDataFrame([(1000, 1, 1, "X", None), (2000, 1, 1, "Y", None)],
                                "Claim_ID long, Food_ID long, Receiver_ID long, Status string, Timestamp timestamp_ntz")
    out = CH.insert_rows(t["claims"], new, "claims")
    assert out.count() == 7
    assert out.where("Claim_ID = 1000").collect()[0].Status == "Completed"


def _batch(spark, rows):
    return spark.createDataFrame(
        rows, "op string, seq long, Provider_ID long, set array<string>, Name string, Type string, City string"
    )


def test_update_partial_null_missing_and_last_wins(spark):
    t = sample(spark)
    batch = _batch(spark, [
        ("U", 1, 1, ["Name"], "First", None, None),
        ("U", 3, 1, ["Name", "City"], "Third", None, "Capital"),
        ("U", 2, 1, ["Name"], "Second", None, None),
        ("U", 1, 2, ["Name"], None, "ignored", None),
        ("U", 1, 99, ["Name"], "Ghost", None, None),
    ])
    out = {r.Provider_ID: r for r in CH.update_rows(t["providers"], batch, "providers").collect()}
    assert (out[1].Name, out[1].City, out[1].Type) == ("Third", "Capital", "Restaurant")
    assert (out[2].Name, out[2].Type) == (None, "Grocery")
    assert 99 not in out and len(out) == 3


def test_delete_effects(spark):
    t = sample(spark)
    keys = spark.createDataFrame([(1,)], "k long")
    out = CH.delete_rows(t, "providers", keys)
    assert out["providers"].count() == 2
    assert {r.Food_ID for r in out["food_listings"].where("Provider_ID IS NULL").collect()} == {100, 101, 104}
    out = CH.delete_rows(t, "food_listings", spark.createDataFrame([(100,)], "k long"))
    assert {r.Claim_ID for r in out["claims"].collect()} == {1002, 1003, 1004, 1005}
    out = CH.delete_rows(t, "receivers", spark.createDataFrame([(10,)], "k long"))
    assert {r.Claim_ID for r in out["claims"].where("Receiver_ID IS NULL").collect()} == {1000, 1002}
    assert IN.fk_violations(out).count() == 0


def test_complete_and_rekey(spark):
    t = sample(spark)
    done = CH.complete_claims(t["claims"], spark.createDataFrame([(1001,), (1002,)], "Claim_ID long"))
    assert {r.Status for r in done.where("Claim_ID in (1001, 1002)").collect()} == {"Completed"}
    m = spark.createDataFrame([(1, 501)], "old_id long, new_id long")
    out = CH.rekey_rows(t, "providers", m)
    assert {r.Provider_ID for r in out["providers"].collect()} == {501, 2, 3}
    assert out["food_listings"].where("Provider_ID = 501").count() == 2
    assert IN.fk_violations(out).count() == 0


def test_apply_changes_batch(spark):
    t = sample(spark)
    batch = spark.createDataFrame(
        [("U", 1, 10, ["City"], None, None, "Moved", None),
         ("D", 2, 12, None, None, None, None, None),
         ("I", 3, None, None, "New", "NGO", "Capital", None)],
        "op string, seq long, Receiver_ID long, set array<string>, Name string, Type string, City string, Contact string",
    )
    out = CH.apply_changes(t, "receivers", batch)
    rec = {r.Receiver_ID: r for r in out["receivers"].collect()}
    assert rec[10].City == "Moved" and 12 not in rec and rec[13].Name == "New"
    assert out["claims"].where("Receiver_ID IS NULL").count() == 2  # 1003, 1004 lost their receiver


def test_mixed_batch_in_seq_order(spark):
    """The folded batch equals its rows applied one after another, also on replay of keyed inserts."""
    from builders import sample

    tables = sample(spark)
    feed = [
        (1, "I", 500, "New", None), (2, "U", 500, "Renamed", ["Name"]), (3, "I", 501, "Gone", None), (4, "D", 501, None, None),
        (5, "I", 502, "First", None), (6, "I", 502, "Second", None), (7, "D", 10, None, None), (8, "U", 10, "Late", ["Name"]),
        (9, "I", 10, "Again", None), (10, "U", 10, "Newest", ["Name"]), (11, "I", 11, "Taken", None), (12, "U", 11, "Mine", ["Name"]),
        (13, "U", 503, "Early", ["Name"]), (14, "I", 503, "Born", None), (15, "D", 504, None, None), (16, "I", 504, "After", None),
    ]
    changes = spark.createDataFrame(feed, "seq long, op string, Receiver_ID long, Name string, set array<string>")
    state = {r.Receiver_ID: r.Name for r in tables["receivers"].collect()}
    rejected = set()
    for seq, op, key, name, _ in feed:
        if op == "I" and key in state:
            rejected.add((key, seq))
        elif op == "I" or op == "U" and key in state:
            state[key] = name
        elif op == "D":
            state.pop(key, None)
    out = CH.apply_changes(tables, "receivers", changes)
    rows = [(r.Receiver_ID, r.Name) for r in out["receivers"].collect()]
    assert sorted(rows) == sorted(state.items())
    assert {(r.Receiver_ID, r.seq) for r in CH.rejected_inserts(tables, "receivers", changes).collect()} == rejected
    assert all(r.Receiver_ID != 10 for r in out["claims"].collect() if r.Receiver_ID is not None)


def test_repeated_new_keys_enter_once(spark):
    from builders import sample

    tables = sample(spark)
    new = spark.createDataFrame([(700, "b"), (700, "a"), (10, "taken")], "Receiver_ID long, Name string")
    rows = CH.insert_rows(tables["receivers"], new, "receivers").where("Receiver_ID in (700, 10)").collect()
    assert sorted((r.Receiver_ID, r.Name) for r in rows) == [(10, "Shelter"), (700, "a")]
