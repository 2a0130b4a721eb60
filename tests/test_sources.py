"""CSV round trip, NA tokens, catalog tables, versions, JDBC options."""

import os
import tempfile

import pytest

from builders import sample
from larder.operators import clean as CL
from larder.sources import csv as CSV
from larder.sources import jdbc as JDBC
from larder.sources import tables as TB


def test_csv_multiline_quotes_and_na(spark):
    d = tempfile.mkdtemp(prefix="larder-csv-")
    path = os.path.join(d, "providers.csv")
    with open(path, "w") as fh:
        fh.write('Provider_ID,Name,Type,Address,City,Contact\n')
        fh.write('1,"Acme, ""The"" Best",Restaurant,"12 Main\nSt, Apt 4",Springfield,+1-555-0100\n')
        fh.write('2,NA,N/A,,null,nan\n')
    raw = CSV.read_table_csv(spark, path, "providers")
    rows = {r.Provider_ID: r for r in raw.collect()}
    assert len(rows) == 2
    assert rows["1"].Address == "12 Main\nSt, Apt 4" and rows["1"].Name == 'Acme, "The" Best'
    assert all(rows["2"][c] is None for c in ("Name", "Type", "Address", "City", "Contact"))
    clean = {r.Provider_ID: r for r in CL.clean_providers(raw).collect()}
    assert clean[1].Name == 'Acme "The" Best' and clean[1].Address == "12 Main St, Apt 4"
    assert clean[1].Contact == "15550100"

    out = os.path.join(d, "out")
    CSV.write_csv(raw, out)
    back = {r.Provider_ID: r for r in CSV.read_table_csv(spark, out, "providers").collect()}
    assert back["1"].Address == "12 Main\nSt, Apt 4"


def test_create_and_load_idempotent(spark):
    wh = tempfile.mkdtemp(prefix="larder-wh-")
    db = "larder_test_db"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {db} LOCATION '{wh}'")
    names = TB.create_schema(spark, db, wh)
    assert names[0] == f"{db}.providers"
    t = sample(spark)
    TB.load_tables(spark, t, db)
    TB.load_tables(spark, t, db)  # re-run appends nothing new
    assert TB.scan_table(spark, f"{db}.claims").count() == 6
    assert TB.scan_table(spark, f"{db}.providers").count() == 3


def test_versions(spark):
    root = tempfile.mkdtemp(prefix="larder-ver-")
    t = sample(spark)
    with pytest.raises(FileNotFoundError):
        TB.read_version(spark, root, "providers")
    TB.write_version(t["providers"], root, "providers", 0)
    TB.write_version(t["providers"].where("Provider_ID > 1"), root, "providers", 1)
    assert TB.latest_version(spark, root, "providers") == 1
    assert TB.read_version(spark, root, "providers").count() == 2
    assert TB.read_version(spark, root, "providers", 0).count() == 3
    with open(os.path.join(root, "providers", "_latest", "part-0-broken.parquet"), "wb") as f:
        f.write(b"not parquet")
    with pytest.raises(Exception, match="broken"):
        TB.read_version(spark, root, "providers")


def test_csv_keeps_edge_spaces(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="larder-csv-"), "out")
    df = spark.createDataFrame([("  lead and trail  ", 'a "quoted", line\nnext ')], "a string, b string")
    CSV.write_csv(df, path)
    assert CSV.read_table_csv(spark, path).collect() == df.collect()


def test_jdbc_options(spark, monkeypatch):
    monkeypatch.delenv("LARDER_JDBC_URL", raising=False)
    with pytest.raises(ValueError):
        JDBC.jdbc_options()
    monkeypatch.setenv("LARDER_JDBC_URL", "jdbc:mysql://db.example:3306/food")
    opts = JDBC.jdbc_options(user="reader")
    assert opts["url"].startswith("jdbc:mysql://") and opts["user"] == "reader" and "password" not in opts
    reader = JDBC.jdbc_reader(spark, "claims", 1, 1000, 8)
    assert reader is not None
