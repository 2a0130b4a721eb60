"""The dashboard's canned reports and overview panels as one catalogue of
DataFrame builders.

``dashboard(tables, as_of)`` returns every panel as a lazy DataFrame over the
loaded parquet tables, each planned separately by Catalyst, so every panel
reads its own columns only and its filters reach the scan.  The tables are not
cached: they are larger than the executors' memory.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame

from larder.operators import filters as FL
from larder.operators import metrics as M

Tables = dict[str, DataFrame]

# Every builder takes the tables and the report date (None = today).
REPORT_GROUPS: dict[str, dict[str, Callable[[Tables, dt.date | None], DataFrame]]] = {
    "Who gives and who takes": {
        "City: providers": lambda t, as_of: M.providers_by_city(t["providers"]),
        "City: receivers": lambda t, as_of: M.receivers_by_city(t["receivers"]),
        "Provider: most listings": lambda t, as_of: M.most_active_providers(t["food_listings"], t["providers"], 10),
        "Provider: quantity": lambda t, as_of: M.quantity_per_provider(t["food_listings"], t["providers"]),
    },
    "What is given and claimed": {
        "Provider type: quantity": lambda t, as_of: M.volume_by_provider_type(t["food_listings"], t["providers"]),
        "Item: most claims": lambda t, as_of: M.top_claimed_items(t["claims"], t["food_listings"], 10),
        "Provider type: mean quantity": lambda t, as_of: M.avg_quantity_by_provider_type(t["food_listings"], t["providers"]),
        "Receiver: mean quantity": lambda t, as_of: M.avg_claimed_per_receiver(t["claims"], t["food_listings"], t["receivers"]),
    },
    "What may be lost": {
        "Food type: listings": lambda t, as_of: M.listings_by_food_type(t["food_listings"]),
        "Meal type: claims": lambda t, as_of: M.claims_by_meal_type(t["claims"], t["food_listings"]),
        "Expiring within three days": lambda t, as_of: FL.near_expiry(t["food_listings"], as_of, 3, with_id=True),
        "Quantity: donated and claimed": lambda t, as_of: M.donated_vs_claimed(t["claims"], t["food_listings"]),
    },
}


def dashboard(tables: Tables, as_of: dt.date | None = None, facets: dict | None = None) -> dict[str, DataFrame]:
    """Every panel of one page refresh as a lazy DataFrame."""
    facets = facets or {}
    t = tables
    out: dict[str, DataFrame] = {}
    for group in REPORT_GROUPS.values():
        for title, build in group.items():
            out[title] = build(t, as_of)
    facts = FL.facet_filter(FL.listing_facts(t["food_listings"], t["providers"]), **facets)
    out.update({
        "Overview": M.overview_totals(t["providers"], t["receivers"], t["food_listings"]),
        "Next to expire": FL.near_expiry(t["food_listings"], as_of, 3, n=5),
        "Contacts": FL.sample_contacts(t["providers"], 5),
        "Chosen listings": FL.listing_preview(t["food_listings"], t["providers"], 6, **facets),
        "Chosen: food types": M.value_counts(facts, "Food_Type", "Food_Type"),
        "Chosen: providers": M.value_counts(facts, "Provider_Name", "Provider"),
        "Newest: providers": FL.latest_rows(t["providers"], "Provider_ID", 10),
        "Newest: receivers": FL.latest_rows(t["receivers"], "Receiver_ID", 10),
        "Newest: listings": FL.latest_rows(t["food_listings"], "Food_ID", 10),
        "Newest: claims": FL.latest_rows(t["claims"], "Claim_ID", 10),
        "Directory": FL.provider_directory(t["providers"], 500),
        "Choices": FL.facet_values(t["providers"], t["food_listings"]),
    })
    return out


def noop_sink(df: DataFrame, title: str) -> None:
    df.write.format("noop").mode("overwrite").save()


def parquet_sink(root: str) -> Callable[[DataFrame, str], None]:
    """A sink that writes each panel under ``root/<slug>`` (overwriting)."""
    import os
    import re

    def write(df: DataFrame, title: str) -> None:
        slug = re.sub(r"[^A-Za-z0-9]+", "_", title).strip("_").lower()
        df.write.mode("overwrite").parquet(os.path.join(root, slug))

    return write


def csv_sink(root: str) -> Callable[[DataFrame, str], None]:
    """Each panel exported as CSV with a header under ``root/<slug>``."""
    import os
    import re

    from larder.sources.csv import write_csv

    def write(df: DataFrame, title: str) -> None:
        slug = re.sub(r"[^A-Za-z0-9]+", "_", title).strip("_").lower()
        write_csv(df, os.path.join(root, slug), mode="overwrite")

    return write


def refresh(panels: dict[str, DataFrame], sink: Callable[[DataFrame, str], None] = noop_sink,
            max_parallel: int = 8) -> None:
    """Materialise every panel, submitting up to ``max_parallel`` Spark jobs at
    once from driver threads.  Most panels are small jobs that leave cores
    idle; running them side by side fills the cluster.  Results go to
    ``sink`` (e.g. parquet for the UI to read), never through the driver:
    some panels have one row per provider or receiver.
    """
    with ThreadPoolExecutor(max_workers=max_parallel) as pool:
        for f in [pool.submit(sink, df, title) for title, df in panels.items()]:
            f.result()
