"""Date layouts, strict CSV lines, and plans of the driver adapter."""

import datetime as dt
import re

import pytest
from conftest import SF_SMALL
from larder.functions.coerce import coerce_timestamp, day_first_of, layout_counts
from larder.operators import clean as CL
from larder.operators import metrics as M
from larder.sources.csv import read_table_csv, read_table_csv_split
from larder.sources.driver import DriverTables
from larder.sources.tables import new_rows_only

AT = dt.datetime(2025, 3, 5, 10, 0)
DAY = dt.datetime(2025, 3, 5)
LAYOUTS = {
    "2025-03-05 10:00:00.123": AT.replace(microsecond=123000),
    "2025-03-05T10:00:00.123456789": AT.replace(microsecond=123456),
    "2025-03-05T10:00:00Z": AT,
    "2025-03-05 10:00:00+02:00": AT,
    "2025-3-5": DAY,
    "2025/03/05": DAY,
    "20250305": DAY,
    "05-03-2025": dt.datetime(2025, 5, 3),
    "25-03-2025": None,
    "Mar 5, 2025": DAY,
    "may 5 2025": dt.datetime(2025, 5, 5),
    "5 March 2025 12:05 pm": DAY.replace(hour=12, minute=5),
    "3/5/2025 12:05 AM": DAY.replace(minute=5),
    "3/5/2025 10:00 AM": AT,
    "3/5/2025 13:00 PM": None,
    "2025-03-05 10:00:60": None,
    "2025-03-05 25:00": None,
    "2025-02-30": None,
    "2025|3|5||||": None,
    "5 Mayo 2025": None,
    "x": None,
    "": None,
}


def test_date_layouts(spark):
    df = spark.createDataFrame([(k,) for k in LAYOUTS], "s string")
    got = {r.s: r.t for r in df.select("s", coerce_timestamp("s").alias("t")).collect()}
    assert got == LAYOUTS


HEAD = "Claim_ID,Food_ID,Receiver_ID,Status,Timestamp\n1,2,3,ok,2025-01-01\n"


@pytest.mark.parametrize("line", ["1,2,3,ok,2025-01-01,more\n", "1,2,3,ok\n", '1,2,3,"o\nk",2025-01-01\n'])
def test_lines_that_do_not_fit_raise(spark, tmp_path, line):
    (tmp_path / "c.csv").write_text(HEAD + line)
    with pytest.raises(Exception, match="(?i)malformed"):
        read_table_csv(spark, str(tmp_path / "c.csv"), "claims").collect()


def test_records_over_lines_on_request(spark, tmp_path):
    (tmp_path / "c.csv").write_text(HEAD + '1,2,3,"o\nk",2025-01-01\n')
    assert [r.Status for r in read_table_csv(spark, str(tmp_path / "c.csv"), "claims", multi_line=True).collect()] == ["ok", "o\nk"]


def test_unparsed_dates_are_listed(spark):
    raw = spark.createDataFrame([("1", "2025-01-01"), ("2", "soon"), ("3", None)], "Claim_ID string, Timestamp string")
    assert [r.Claim_ID for r in CL.unparsed_dates(raw, "claims").collect()] == ["2"]


def test_a_key_given_twice_enters_once(spark):
    columns = "Receiver_ID long, Name string"
    old = spark.createDataFrame([(1, "a")], columns)
    new = spark.createDataFrame([(1, "b"), (2, "d"), (2, "c")], columns)
    assert [tuple(r) for r in new_rows_only(old, new, "receivers").collect()] == [(2, "c")]


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


def test_adapter_plans(spark):
    t = DriverTables(spark, SF_SMALL)
    assert "s_suppkey" not in plan(M.available_quantity(t.food_listings))  # the provider join is gone
    assert "SortAggregate" not in plan(t.claims)  # the first line is hash-aggregated
    cleaned = CL.clean_listings(t.food_listings)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(p_size,0)" in cleaned


DAY_FIRST = {
    "25/05/2025": dt.datetime(2025, 5, 25),
    "03/05/2025": dt.datetime(2025, 5, 3),
    "3-5-2025 10:00": dt.datetime(2025, 5, 3, 10, 0),
    "3/5/2025 12:05 AM": dt.datetime(2025, 5, 3, 0, 5),
    "05/25/2025": None,
    "2025-03-05": DAY,
    "Mar 5, 2025": DAY,
    "20250305": DAY,
    "x/y/z": None,
    "": None,
    None: None,
}


def test_a_column_has_one_layout(spark):
    df = spark.createDataFrame([(k,) for k in DAY_FIRST], "s string")
    # Two values demand day first, one demands month first: the column is day first.
    counts = layout_counts(df, "s")
    assert counts.collect()[0].asDict() == {"n_day_first": 1, "n_month_first": 1, "n_open": 3}
    more = df.unionByName(spark.createDataFrame([("31/12/2024",)], "s string"))
    one = day_first_of(layout_counts(more, "s"))
    got = {r.s: r.t for r in df.select("s", coerce_timestamp("s", day_first=one).alias("t")).collect()}
    assert got == DAY_FIRST
    # A tie and a column without evidence are read month first; counts of parts add up.
    for frame in (df, df.where("s = '03/05/2025'"), df.limit(0)):
        row = frame.sparkSession.range(1).select(day_first_of(layout_counts(frame, "s")).alias("d")).first()
        assert row.d is False
    parts = layout_counts(more, "s").unionByName(layout_counts(df.where("s = '25/05/2025'"), "s"))
    assert spark.range(1).select(day_first_of(parts).alias("d")).first().d is True


def test_claims_of_a_day_first_file(spark, tmp_path):
    (tmp_path / "c.csv").write_text("Claim_ID,Food_ID,Receiver_ID,Status,Timestamp\n1,2,3,ok,03/05/2025\n2,2,3,ok,25/05/2025 10:00\n3,2,3,ok,05/25/2025\n4,2,3,ok,26/05/2025\n")
    raw = read_table_csv(spark, str(tmp_path / "c.csv"), "claims")
    one = CL.column_day_first(raw, "claims")
    got = {r.Claim_ID: r.Timestamp for r in CL.clean_claims(raw, one).collect()}
    assert got == {1: dt.datetime(2025, 5, 3), 2: dt.datetime(2025, 5, 25, 10), 4: dt.datetime(2025, 5, 26)}
    assert [r.Timestamp for r in CL.unparsed_dates(raw, "claims", one).collect()] == ["05/25/2025"]


LINES = '''1,2,3,ok,2025-01-01
2,2,3,ok
3,2
4,2,3,ok,2025-01-01,more
5,2,3,"ok,2025-01-01
6,2,3,"o, ""k\"\"",2025-01-01
7,2,3,"a" b "c",2025-01-01,x

8,,NA,,
'''


def test_lines_that_do_not_fit_are_set_aside(spark, tmp_path):
    (tmp_path / "c.csv").write_text("Claim_ID,Food_ID,Receiver_ID,Status,Timestamp\n" + LINES)
    rows, rejects = read_table_csv_split(spark, str(tmp_path / "c.csv"), "claims")
    got = {r.Claim_ID: tuple(r)[1:] for r in rows.collect()}
    assert got == {
        "1": ("2", "3", "ok", "2025-01-01"), "2": ("2", "3", "ok", None), "3": ("2", None, None, None),
        "6": ("2", "3", 'o, "k"', "2025-01-01"), "8": (None, None, None, None),
    }
    lost = {r.line: r.reason for r in rejects.collect()}
    assert lost == {
        "4,2,3,ok,2025-01-01,more": "too many fields", '5,2,3,"ok,2025-01-01': "open quote", '7,2,3,"a" b "c",2025-01-01,x': "too many fields",
    }
    # Fitting lines give the same either way; the columns may stand in another order.
    (tmp_path / "d.csv").write_text("Status,Timestamp,Claim_ID,Receiver_ID,Food_ID,Extra\nok,2025-01-01,1,3,2,z\n")
    same, none = read_table_csv_split(spark, str(tmp_path / "d.csv"), "claims")
    assert same.collect() == read_table_csv(spark, str(tmp_path / "d.csv"), "claims").collect() and none.count() == 0


def test_split_records_over_lines(spark, tmp_path):
    (tmp_path / "p.csv").write_text('Provider_ID,Name,Type,Address,City,Contact\n1,a,b,"street 1\ntown",c,1\n2,a,b\n3,a,b,"x",c,1,9\n')
    rows, rejects = read_table_csv_split(spark, str(tmp_path / "p.csv"), "providers")
    got = {r.Provider_ID: (r.Address, r.City) for r in rows.collect()}
    assert got == {"1": ("street 1\ntown", "c"), "2": (None, None)}
    assert [tuple(r) for r in rejects.collect()] == [('3,a,b,"x",c,1,9', "too many fields")]


def test_empty_parts_of_a_date_reach_no_cast(spark):
    # A failed cast inside a lambda costs an exception a value, also where it gives null.
    text = spark.createDataFrame([("5/3/2025",)], "s string")
    for day_first in (False, day_first_of(layout_counts(text, "s"))):
        plan = text.select(coerce_timestamp("s", day_first=day_first).alias("t"))._jdf.queryExecution().optimizedPlan().toString()
        casts = [plan[max(0, m.start() - 5) : m.start()] for m in re.finditer(r"try_cast\(lambda ", plan)]
        assert casts and set(casts) <= {"THEN ", "else "}
