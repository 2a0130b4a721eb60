"""Batches over several tables, replay and key changes, against plain simulations."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from larder.operators import changes as CH
from larder.operators import referential as RF
from larder.operators import rekey as RK
from larder.schemas import FOREIGN_KEYS, PRIMARY_KEYS, SCHEMAS, parents_of
from conftest import SF_SMALL
from larder.plans import driver_batches
from larder.sources.driver import DriverTables

TABLES = ("providers", "receivers", "food_listings", "claims")


def simulate(tables, batch, high):
    """Statement by statement, as a database with enforced keys."""
    tables = {t: {k: dict(r) for k, r in rows.items()} for t, rows in tables.items()}
    rejected = []

    def delete(table, k):
        if tables[table].pop(k, None) is None:
            return
        for fk in FOREIGN_KEYS:
            if fk.parent == table:
                for c in [c for c, r in tables[fk.child].items() if r[fk.column] == k]:
                    if fk.on_delete == "cascade":
                        delete(fk.child, c)
                    else:
                        tables[fk.child][c][fk.column] = None

    def missing(table, values):
        for fk in parents_of(table):
            v = values.get(fk.column)
            if v is not None and v not in tables[fk.parent]:
                return RF.missing_reason(fk)

    for seq, table, op, k, names, values in sorted(batch, key=lambda x: x[0]):
        if op == "I":
            reason = RF.TAKEN if k in tables[table] else missing(table, values)
            if reason:
                rejected.append((table, k, seq, reason))
            else:
                tables[table][k] = {f.name: values.get(f.name) for f in SCHEMAS[table].fields} | {PRIMARY_KEYS[table]: k}
        elif op == "D":
            delete(table, k)
        elif k in tables[table]:
            given = {c: values.get(c) for c in names}
            reason = missing(table, given)
            if reason:
                rejected.append((table, k, seq, reason))
            else:
                tables[table][k].update(given)
    return tables, sorted(rejected)


def material(seed):
    rng = random.Random(seed)
    ref = lambda n: rng.choice([None, *range(1, n + 4)])
    tables = {t: {} for t in TABLES}
    for k in range(1, 9):
        tables["providers"][k] = dict(Provider_ID=k, Name=f"p{k}", Type="a", Address=None, City="x", Contact=None)
        tables["receivers"][k] = dict(Receiver_ID=k, Name=f"r{k}", Type="a", City="x", Contact=None)
    for k in range(1, 13):
        tables["food_listings"][k] = dict(Food_ID=k, Food_Name=f"f{k}", Quantity=k, Expiry_Date=dt.date(2025, 1, k), Provider_ID=rng.choice([None, *range(1, 9)]),
                                          Provider_Type="a", Location="x", Food_Type="v", Meal_Type="l")
    for k in range(1, 25):
        tables["claims"][k] = dict(Claim_ID=k, Food_ID=rng.choice([None, 1, 1, *range(1, 13)]), Receiver_ID=rng.choice([None, *range(1, 9)]), Status="Pending", Timestamp=None)
    batch = []
    for seq in range(1, 120):
        table = rng.choice(["providers", "receivers", "food_listings", "food_listings", "claims", "claims", "claims"])
        size = {"providers": 8, "receivers": 8, "food_listings": 12, "claims": 24}[table]
        op, k = rng.choice("IUUD" if table == "claims" else "IID"), rng.randint(1, size + 4)
        values = {
            "providers": {"Name": f"n{seq}", "City": "y"}, "receivers": {"Name": f"n{seq}", "City": "y"},
            "food_listings": {"Food_Name": f"n{seq}", "Quantity": seq, "Provider_ID": ref(8)},
            "claims": {"Status": f"s{seq}", "Food_ID": ref(12), "Receiver_ID": ref(8)},
        }[table]
        names = rng.sample(sorted(values), rng.randint(1, len(values))) if op == "U" else []
        batch.append((seq, table, op, k, names, values))
    return tables, batch


def frames(spark, tables, batch):
    out = {t: spark.createDataFrame([tuple(r[f.name] for f in SCHEMAS[t].fields) for r in rows.values()], SCHEMAS[t]) for t, rows in tables.items()}
    told = {}
    for t in TABLES:
        rows = [x for x in batch if x[1] == t]
        if not rows:
            continue
        cols = sorted({c for x in rows for c in x[5]})
        kinds = {f.name: f.dataType.simpleString() for f in SCHEMAS[t].fields}
        schema = ", ".join(["op string", "seq long", "key long", "`set` array<string>", *(f"{c} {kinds[c]}" for c in cols)])
        told[t] = spark.createDataFrame([(op, seq, k, names, *[v.get(c) for c in cols]) for seq, _, op, k, names, v in rows], schema).withColumnRenamed("key", PRIMARY_KEYS[t])
    return out, told


def rows_of(df, table):
    return {r[PRIMARY_KEYS[table]]: r.asDict() for r in df.collect()}


def test_a_batch_is_what_statements_one_by_one_give(spark):
    for seed in range(4):
        tables, batch = material(seed)
        base, told = frames(spark, tables, batch)
        got, rejected = RF.apply_batch(base, {t: df.repartition(3) for t, df in told.items()})
        want, lost = simulate(tables, batch, {})
        for t in TABLES:
            out = rows_of(got[t], t)
            assert got[t].count() == len(out) and got[t].schema.names == SCHEMAS[t].names
            assert out == want[t], (seed, t)
        assert sorted(map(tuple, rejected.collect())) == lost and lost


def test_parents_alone_and_no_changes(spark):
    tables, _ = material(9)
    base, told = frames(spark, tables, [(1, "providers", "D", 2, [], {"Name": None}), (2, "food_listings", "D", 1, [], {})])
    got, rejected = RF.apply_batch(base, told)
    want, _ = simulate(tables, [(1, "providers", "D", 2, [], {}), (2, "food_listings", "D", 1, [], {})], {})
    assert {t: rows_of(got[t], t) for t in TABLES} == want and rejected.count() == 0
    same, none = RF.apply_batch(base, {})
    assert {t: rows_of(same[t], t) for t in TABLES} == tables and none.count() == 0


def test_inserts_without_a_key_are_numbered_and_checked(spark):
    tables, _ = material(9)
    base, _ = frames(spark, tables, [])
    claims = spark.createDataFrame(
        [("I", 5, None, [], 3, "a"), ("I", 3, None, [], 999, "b"), ("I", 4, None, [], None, "c"), ("I", 6, 40, [], 2, "d"), ("U", 7, 42, ["Status"], None, "e")],
        "op string, seq long, Claim_ID long, `set` array<string>, Food_ID long, Status string",
    )
    got, rejected = RF.apply_batch(base, {"claims": claims}, {"claims": spark.createDataFrame([(50,)], "m long")})
    new = {k: (r["Food_ID"], r["Status"]) for k, r in rows_of(got["claims"], "claims").items() if k > 24}
    # Numbers follow seq above every key ever used; a rejected insert has used its number.
    assert new == {52: (None, "c"), 53: (3, "a"), 40: (2, "d")}
    assert [tuple(r) for r in rejected.collect()] == [("claims", 51, 3, "Food_ID has no food_listings row")]


def test_a_batch_given_twice_is_applied_once(spark):
    tables, _ = material(9)
    base, _ = frames(spark, tables, [])
    batch = spark.createDataFrame(
        [("U", 1, 500, ["Status"], 2, "early"), ("I", 2, 500, [], 2, "new"), ("I", 3, None, [], 3, "unnamed"), ("D", 4, 7, [], None, None)],
        "op string, seq long, Claim_ID long, `set` array<string>, Food_ID long, Status string",
    )
    once, _, ledgers = RF.apply_once(base, {"claims": batch}, {})
    twice, lost, again = RF.apply_once(once, {"claims": batch}, ledgers)
    want = rows_of(once["claims"], "claims")
    assert want[500]["Status"] == "new" and want[501]["Status"] == "unnamed" and 7 not in want
    assert rows_of(twice["claims"], "claims") == want and lost.count() == 0
    assert sorted(map(str, again["claims"].collect())) == sorted(map(str, ledgers["claims"].collect()))
    # A part of it given again with something new: only the new is applied.
    more = batch.unionByName(spark.createDataFrame([("U", 9, 500, ["Status"], None, "late")], batch.schema))
    third, _, _ = RF.apply_once(twice, {"claims": more}, again)
    assert rows_of(third["claims"], "claims") == want | {500: want[500] | {"Status": "late"}}


def moved(keys, moves):
    at, lost = {k: k for k in keys}, []
    for seq, a, b in sorted(moves):
        if a == b:
            continue
        if a not in at:
            lost.append((seq, a, b, RK.NO_ROW))
        elif b in at:
            lost.append((seq, a, b, RK.TAKEN))
        else:
            at[b] = at.pop(a)
    return sorted((first, last) for last, first in at.items() if first != last), sorted(lost)


def test_moves_one_after_the_other(spark):
    cases = [
        ([1, 2, 3, 4], [(1, 1, 9), (2, 2, 1), (3, 9, 2)]),  # a swap
        ([1], [(1, 1, 2), (2, 2, 3), (3, 3, 4), (4, 4, 1)]),  # there and back
        ([1, 2], [(1, 1, 5), (2, 1, 6), (3, 2, 5), (3, 7, 8)]),  # doubled, taken, none
        ([], [(1, 1, 2)]), ([1, 2], []),
        ([1, 2], [(2, 2, 3), (1, 1, 2), (3, 1, 2), (4, 1, 1)]),
    ]
    rng = random.Random(6)
    cases += [(rng.sample(range(14), 8), [(s, rng.randrange(14), rng.randrange(14)) for s in range(60)]) for _ in range(3)]
    for keys, moves in cases:
        paths, lost = RK.compose_moves(spark.createDataFrame([(k,) for k in keys], "k long"), spark.createDataFrame(moves, "seq long, old_id long, new_id long"))
        assert (sorted(map(tuple, paths.collect())), sorted(map(tuple, lost.collect()))) == moved(keys, moves), (keys, moves)


def test_a_mapping_at_once(spark):
    keys = spark.createDataFrame([(k,) for k in range(1, 13)], "k long")
    mapping = [
        (1, 2), (2, 1),  # a swap holds
        (3, 20), (3, 21),  # two new ids: the smallest counts
        (4, 22), (5, 22),  # two old ids: the smallest counts
        (6, 7), (7, 8), (8, 9),  # ends at a key that stays: all fall
        (10, 11), (11, 30),  # a chain with a free end holds
        (12, 12), (99, 100),  # nothing to do, no row
    ]
    good, bad = RK.audit_mapping(keys, spark.createDataFrame(mapping, "old_id long, new_id long"))
    assert sorted(map(tuple, good.collect())) == [(1, 2), (2, 1), (3, 20), (4, 22), (10, 11), (11, 30)]
    assert sorted(map(tuple, bad.collect())) == [
        (3, 21, RK.TWO_NEW), (5, 22, RK.TWO_OLD), (6, 7, RK.TAKEN), (7, 8, RK.TAKEN), (8, 9, RK.TAKEN), (99, 100, RK.NO_ROW)
    ]


def test_rekeyed_rows_never_share_a_key(spark):
    tables, _ = material(9)
    base, _ = frames(spark, tables, [])
    mapping = spark.createDataFrame([(1, 5), (1, 60), (2, 5), (3, 4), (4, 3)], "old_id long, new_id long")
    out = CH.rekey_rows(base, "providers", mapping)
    # 1 -> 5 and 2 -> 5 meet a row that stays; 1 -> 60 came second for 1; the swap holds.
    assert sorted(r[0] for r in out["providers"].select("Provider_ID").collect()) == list(range(1, 9))
    names = {r["Provider_ID"]: r["Name"] for r in out["providers"].collect()}
    assert (names[3], names[4], names[1]) == ("p4", "p3", "p1")
    assert out["food_listings"].count() == len(tables["food_listings"])
    assert {r["Food_ID"] for r in out["food_listings"].where("Provider_ID = 3").collect()} == {k for k, r in tables["food_listings"].items() if r["Provider_ID"] == 4}


def test_steps_of_a_linked_batch_read_written_tables(spark):
    t = DriverTables(spark, SF_SMALL)
    for query in (driver_batches._linked_claims, driver_batches._linked_listings, driver_batches._linked_rejected):
        plan = query(t)._jdf.queryExecution().optimizedPlan().toString()
        assert "l_orderkey" not in plan and "l_partkey" not in plan
