"""Filters and projections reach the parquet scan of loaded tables."""

import contextlib
import io
import re

import pytest

from conftest import SF_SMALL
from larder.plans import registry
from larder.session import scratch_path
from larder.sources.driver import DriverTables
from larder.sources.tables import read_tables, write_tables


def _plan(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


@pytest.fixture(scope="module")
def loaded(spark):
    registry.queries()
    root = scratch_path(spark, "pushdown")
    write_tables(DriverTables(spark, SF_SMALL).as_dict(), root, 0)
    return DriverTables(spark, SF_SMALL).use(read_tables(spark, root, version=0))


@pytest.mark.parametrize("name, pushed", [
    ("near_expiry_90d", ["GreaterThanOrEqual(Expiry_Date", "LessThanOrEqual(Expiry_Date"]),
    ("expired_listings", ["LessThan(Expiry_Date"]),
    ("pending_claims", ["EqualTo(Status,Pending)"]),
    ("facet_filter", ["In(City", "In(Food_Type"]),
    ("complete_old_open_claims", ["LessThan(Timestamp"]),
])
def test_predicates_pushed(loaded, name, pushed):
    plan = _plan(registry.REGISTRY[name].build(loaded))
    found = " ".join(re.findall(r"PushedFilters: \[[^\n]*", plan))
    for p in pushed:
        assert p in found, (name, p)


def test_projection_pruned(loaded):
    plan = _plan(registry.REGISTRY["claims_per_item"].build(loaded))
    schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", plan)
    assert "struct<Claim_ID:bigint,Food_ID:bigint>" in schemas
    assert all("Status" not in s and "Timestamp" not in s for s in schemas)
