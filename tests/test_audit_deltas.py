"""Audits of a batch, search by postings, clustered files."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from larder.operators import audit_deltas as AD
from larder.operators import filters as FL
from larder.operators import integrity as IN
from larder.operators import name_index as NI
from larder.schemas import PRIMARY_KEYS, SCHEMAS
from larder.sources.tables import read_version, write_tables


def made(spark, seed):
    rng = random.Random(seed)
    pick = lambda n: rng.choice([None, *range(1, n + 2)])
    rows = {
        "providers": [(rng.choice([k, k, 1]), "p" * rng.choice([1, 300]), "a", None, "x", None) for k in range(1, 8)],
        "receivers": [(k, "r", "t", "x", None) for k in range(1, 8)],
        "food_listings": [(pick(20), "f", 1, None, pick(7), None, None, None, None) for _ in range(1, 21)],
        "claims": [(k, rng.choice([3, pick(20)]), pick(7), "s", None) for k in range(1, 60)],
    }
    # Keys may be null here: faulty tables are what is audited.
    return {t: spark.createDataFrame(r, SCHEMAS[t].simpleString()) for t, r in rows.items()}


def full(tables):
    pk = IN.pk_violations(tables).collect()
    fk = IN.fk_violations(tables).collect()
    return {(r.table_name, PRIMARY_KEYS[r.table_name], r.key_value, r.n_rows) for r in pk} | {tuple(r) for r in fk}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_a_batch_is_audited_like_the_whole(spark, seed):
    rng = random.Random(seed)
    was = made(spark, seed)
    changed, now = {}, {}
    for t, df in was.items():
        rows = [tuple(r) for r in df.collect()]
        old = rng.sample(rows, 5)
        new = [tuple(r) for r in made(spark, seed + 50)[t].limit(4).collect()]
        left = list(rows)
        for r in old:
            left.remove(r)
        schema = SCHEMAS[t].simpleString()
        changed[t] = (spark.createDataFrame(old, schema), spark.createDataFrame(new, schema))
        now[t] = spark.createDataFrame(left + new, schema)
    state = AD.audit_state(was).checkpoint()
    after, told = AD.audit_batch(state, changed)
    before, wanted = full(was), full(now)
    rows = [tuple(r) for r in told.collect()]
    gone, come = ({r[1:] for r in rows if r[0] == c} for c in ("gone", "appeared"))
    assert len(rows) == len(gone) + len(come)
    assert gone == before - wanted and come == wanted - before
    assert sorted(map(repr, after.select(*state.columns).collect())) == sorted(map(repr, AD.audit_state(now).collect()))
    assert {tuple(r) for r in AD.violations(after).select(*state.columns).collect()} == wanted
    # Lengths follow from the changed rows.
    lengths = {tuple(r) for r in IN.length_violations(now).collect()}
    had = {tuple(r) for r in IN.length_violations(was).collect()}
    for r in AD.length_changes(changed).collect():
        assert (tuple(r)[1:] in lengths) if r.change == "appeared" else (tuple(r)[1:] in had)


def test_tables_are_not_read_for_a_batch(spark, tmp_path):
    tables = made(spark, 1)
    for t, df in tables.items():
        df.write.parquet(str(tmp_path / t))
    state = AD.audit_state({t: spark.read.parquet(str(tmp_path / t)) for t in tables}).checkpoint()
    one = spark.createDataFrame([(3, "f", 1, None, 2, None, None, None, None)], SCHEMAS["food_listings"].simpleString())
    _, told = AD.audit_batch(state, {"food_listings": (one, one.limit(0))})
    assert "parquet" not in told._jdf.queryExecution().optimizedPlan().toString().lower()


NAMES = ["Anna Müller", "ANNABEL", "Banana", "an", "", None, "ßtraße", "na%na", "x_y z", "日本語テキスト", "aaa", "back\\slash", "Ann A"]


def test_search_by_postings_is_the_scan(spark):
    rows = spark.createDataFrame(list(enumerate(NAMES * 3)), "k long, name string")
    index = NI.postings(rows, "k", "name").checkpoint()
    counts = NI.gram_counts(index)
    for pattern in ["ann", "NAN", "anna", "nnabe", "a", "", "an", "n%n", "_y ", "本語テ", "aaa", "müller", "zzz", "raße", "k\\s", "banana", "ann a"]:
        want = sorted(r.k for r in FL.contains_filter(rows, "name", pattern).collect())
        for c in (None, counts):
            assert sorted(r.k for r in NI.search(rows, "k", "name", pattern, index, c).collect()) == want, pattern
    plan = NI.search(rows, "k", "name", "nnabe", index, counts)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "gram" in plan
    assert "LeftSemi" not in NI.search(rows, "k", "name", "n%n", index, counts)._jdf.queryExecution().optimizedPlan().toString()


def test_expiring_listings_lie_in_few_files(spark, tmp_path):
    day = dt.date(2025, 1, 1)
    # Dates in no order; a third of the rows share one.
    rows = [(k, "f", 1, day if k % 3 == 0 else day + dt.timedelta(days=k * 7919 % 1000), 1, "a", "x", "v", "l") for k in range(9000)]
    listings = spark.createDataFrame(rows, SCHEMAS["food_listings"]).repartition(8)
    write_tables({"food_listings": listings}, str(tmp_path), files=24)
    table = read_version(spark, str(tmp_path), "food_listings")
    assert table.count() == 9000
    as_of = day + dt.timedelta(days=500)
    near = table.where(F.col("Expiry_Date").between(as_of, as_of + dt.timedelta(days=3)))
    files = {r[0]: (r[1], r[2]) for r in table.groupBy(F.input_file_name()).agg(F.min("Expiry_Date"), F.max("Expiry_Date")).collect()}
    hit = {r[0] for r in near.select(F.input_file_name()).distinct().collect()}
    spans = [f for f, (low, high) in files.items() if high >= as_of and low <= as_of + dt.timedelta(days=3)]
    assert len(files) >= 16 and set(spans) == hit and len(hit) <= 2
    # The date of a third of the rows is spread over several files.
    assert sum(low <= day <= high for low, high in files.values()) >= 4
    assert near.count() == sum(as_of <= r[3] <= as_of + dt.timedelta(days=3) for r in rows)
