"""Benchmark: every registered query over the driver tables at one scale.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (8),
BENCH_SHUFFLE_PARTITIONS (default: BENCH_CPUS; AQE coalesces further),
BENCH_RUNS (3).  Steps:

1. ``load_tables``: build the four donation/claims tables from the driver
   parquet files (lineitem aggregation, joins) and write them as parquet
   version 0 under the session's checkpoint folder -- the load step of the
   original pipeline, timed once cold (first job of the JVM) and once warm
   at the end (``load_tables_warm``).
2. every registered query runs against the loaded parquet tables (so filters
   and projections reach the scan), fully materialised through the ``noop``
   sink; the median of BENCH_RUNS warm runs is reported.

3. ``dashboard_refresh``: every panel of one page refresh (24 DataFrames)
   over the loaded tables persisted once, submitted as concurrent jobs;
   median of BENCH_RUNS.

Prints one JSON line: {"metric", "value" (sum of the registered queries'
medians), "unit", "queries", "sf", ...}; ``load_tables``,
``load_tables_warm`` and ``dashboard_refresh`` are reported in ``queries``
but not summed.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)


SKEW_QUERIES = ("claims_per_item", "avg_claimed_per_receiver", "claims_by_provider_city",
                "search_claims_all", "open_claims", "delete_listings_cascade")


def skew_check(spark, tables, root, runs, run) -> dict:
    """The same claim queries with one listing holding a third of all claims.

    Broadcasts are switched off so every join is a shuffle join (the large-
    data case).  The hot listing is the most claimed one; a third of the
    claims (chosen by a hash of Claim_ID) are moved onto it, no rows dropped.
    Reports median seconds per query for the uniform and the skewed table.
    """
    from pyspark.sql import functions as F

    from larder.plans import registry
    from larder.sources.driver import DriverTables
    from larder.sources.tables import read_version, write_version

    claims = tables.claims
    hot = claims.where(F.col("Food_ID").isNotNull()).groupBy("Food_ID").count().orderBy(
        F.col("count").desc(), "Food_ID").limit(1).select("Food_ID").scalar()
    moved = F.pmod(F.xxhash64("Claim_ID"), F.lit(3)) == 0
    skewed = claims.withColumn("Food_ID", F.when(moved, hot).otherwise(F.col("Food_ID")))
    skew_root = os.path.join(root, "skewed")
    write_version(skewed, skew_root, "claims", 0)
    skewed_tables = DriverTables(spark, tables.sf_dir).use(
        dict(tables.as_dict(), claims=read_version(spark, skew_root, "claims", 0)))

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    out = {}
    try:
        for name in SKEW_QUERIES:
            q = registry.REGISTRY[name]
            uni = statistics.median(run(lambda: q.build(tables)) for _ in range(runs))
            hot_t = statistics.median(run(lambda: q.build(skewed_tables)) for _ in range(runs))
            out[name] = {"uniform": round(uni, 4), "hot_key": round(hot_t, 4)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))

    from larder.plans import registry
    from larder.session import get_session, scratch_path
    from larder.sources.driver import DriverTables
    from larder.sources.tables import read_tables, write_tables

    spark = get_session(
        f"local[{cpus}]",
        app_name="larder-bench",
        shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", cpus)),
        extra_conf={"spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry.queries()  # fill the registry

    def run(build) -> float:
        t0 = time.perf_counter()  # some queries run jobs while they are built
        build().write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    root = scratch_path(spark, "bench")
    t0 = time.perf_counter()
    write_tables(DriverTables(spark, sf_dir).as_dict(), root, 0)
    load_s = time.perf_counter() - t0
    tables = DriverTables(spark, sf_dir).use(read_tables(spark, root, version=0))

    timings: dict[str, float] = {"load_tables": round(load_s, 4)}
    for name, q in registry.REGISTRY.items():
        samples = [run(lambda: q.build(tables)) for _ in range(runs)]
        timings[name] = round(statistics.median(samples), 4)

    # One page refresh of the dashboard (24 panels) over the loaded tables.
    from larder.plans import catalog
    from larder.plans.registry import AS_OF

    refresh = []
    for _ in range(runs):
        t0 = time.perf_counter()
        catalog.refresh(catalog.dashboard(tables.as_dict(), AS_OF), catalog.noop_sink, max_parallel=cpus)
        refresh.append(time.perf_counter() - t0)

    skew = skew_check(spark, tables, root, runs, run)

    # The load again, now with a warm JVM (written as version 1).
    t0 = time.perf_counter()
    write_tables(DriverTables(spark, sf_dir).as_dict(), root, 1)
    timings["load_tables_warm"] = round(time.perf_counter() - t0, 4)

    total = sum(timings[k] for k in registry.REGISTRY)
    timings["dashboard_refresh"] = round(statistics.median(refresh), 4)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "sum_of_median_query_seconds",
        "value": round(total, 4),
        "unit": "sec",
        "queries": timings,
        "sf": float(sf.group(1)) if sf else sf_dir,
        "cpus": cpus,
        "runs": runs,
        "load_seconds": round(load_s, 4),
        "dashboard_refresh_seconds": timings["dashboard_refresh"],
        "skew": skew,
        "n_queries": len(registry.REGISTRY),
        "spark": spark.version,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
