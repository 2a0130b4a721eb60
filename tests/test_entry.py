"""Driver contract at sf0.001: every query runs and matches its oracle."""

import datetime as dt
import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from larder.plans import registry

TABLES = "region nation customer supplier part orders lineitem documents".split()


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (dt.date, dt.datetime)):
        return v.isoformat()
    return v


def _key(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["Provider_Type", "Total_Quantity_Donated"]
    assert df.count() > 0


def test_registry_shape():
    q, o = registry.queries(), registry.oracle_sql()
    assert set(o) == set(q)
    assert set(q) <= set(E.queries()) and set(o) <= set(E.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF_SMALL, t + '.parquet')}')")
    return con


def test_all_queries_match_oracle(spark, duck):
    q, o = registry.queries(), registry.oracle_sql()
    bad = []
    for name, sql in o.items():
        df = q[name](spark, SF_SMALL)
        s_rows = df.collect()
        res = duck.execute(sql)
        o_cols = [d[0] for d in res.description]
        o_rows = res.fetchall()
        if sorted(df.columns) != sorted(o_cols) or _key(df.columns, s_rows) != _key(o_cols, o_rows):
            bad.append(name)
    assert bad == []


def test_title_documents_brute_force(spark):
    import pyarrow.parquet as pq

    docs = pq.read_table(os.path.join(SF_SMALL, "documents.parquet"), columns=["doc_id", "text"]).to_pylist()
    expected = {d["doc_id"]: (None if d["text"] is None else d["text"].strip().title()) for d in docs}
    got = {r.doc_id: r.title for r in E.queries()["title_documents"](spark, SF_SMALL).collect()}
    assert got.keys() == expected.keys()
    mismatched = [k for k in got if got[k] != expected[k]]
    assert mismatched == []


def test_time_zone_independent(spark, duck):
    """Dates and zone-less timestamps must not move with the session zone."""
    q, o = E.queries(), E.oracle_sql()
    names = ["insert_reclaims", "latest_claims_by_time", "clean_claims", "near_expiry_90d",
             "complete_old_open_claims", "expiry_status"]
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        for name in names:
            df = q[name](spark, SF_SMALL)
            res = duck.execute(o[name])
            o_cols = [d[0] for d in res.description]
            assert _key(df.columns, df.collect()) == _key(o_cols, res.fetchall()), name
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
