"""Dashboard catalogue and the parameterised SQL entry point."""

import datetime as dt

from conftest import SF_SMALL
from larder.plans import catalog
from larder.plans.sql import run_query
from larder.sources.driver import DriverTables


def test_dashboard_panels_all_run(spark):
    tables = DriverTables(spark, SF_SMALL).as_dict()
    panels = catalog.dashboard(tables, dt.date(1998, 6, 1), {"city": ["NATION_1"]})
    assert len(panels) == 24
    counts = {title: df.count() for title, df in panels.items()}
    assert counts["Overview"] == 1 and counts["Contacts"] == 5 and counts["Newest: claims"] == 10
    assert counts["City: providers"] > 0
    import tempfile

    root = tempfile.mkdtemp(prefix="larder-panels-")
    catalog.refresh(panels, catalog.parquet_sink(root), max_parallel=4)
    assert spark.read.parquet(f"{root}/overview").count() == 1
    from larder.sources.csv import read_table_csv

    out = tempfile.mkdtemp(prefix="larder-csv-panels-")
    catalog.refresh({"Chosen listings": panels["Chosen listings"]}, catalog.csv_sink(out))
    assert read_table_csv(spark, f"{out}/chosen_listings").count() == counts["Chosen listings"]


def test_search_sql_binds_parameters(spark):
    t = DriverTables(spark, SF_SMALL)
    sql = "SELECT * FROM larder_providers WHERE Name ILIKE :name AND City ILIKE :city ORDER BY Provider_ID DESC"
    hostile = "x' OR '1'='1"
    out = run_query(spark, sql, {"name": f"%{hostile}%", "city": "%"}, {"larder_providers": t.providers})
    assert out.count() == 0  # the value is bound, never spliced into the SQL
    out = run_query(spark, sql, {"name": "%supplier#%", "city": "%nation_1%"}, {"larder_providers": t.providers})
    ids = [r.Provider_ID for r in out.collect()]
    assert ids == sorted(ids, reverse=True) and len(ids) > 0


def test_views_of_the_caller_are_left_alone(spark):
    spark.range(3).createOrReplaceTempView("providers")
    t = DriverTables(spark, SF_SMALL)
    out = run_query(spark, "SELECT count(*) AS n FROM providers p JOIN receivers r ON p.City = r.City WHERE p.City <> :c", {"c": "x"}, {"providers": t.providers, "receivers": t.receivers})
    assert spark.table("providers").count() == 3 and not spark.catalog.tableExists("receivers")
    assert out.first().n == t.providers.join(t.receivers, "City").where("City <> 'x'").count()
    try:
        run_query(spark, "SELECT nothing FROM providers", None, {"providers": t.providers})
    except Exception as error:  # noqa: BLE001
        assert "nothing" in str(error)
    assert spark.table("providers").count() == 3
    spark.catalog.dropTempView("providers")
