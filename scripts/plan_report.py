"""Physical-plan shape of every registered query, as a markdown table.

Usage: python scripts/plan_report.py [sf_dir] > PLANS.md-table

The four tables are built once and written as parquet (as bench.py does), so
the plans show what a query over loaded tables looks like: exchanges, joins,
aggregation strategy, Python stages, top-k, pushed filters.  Counts come from
``DataFrame.explain()`` text of the initial adaptive plan; at run time AQE may
still turn a sort-merge join into a broadcast or split a skewed partition.
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SKIP = {"insert_reclaims", "csv_roundtrip_providers"}  # these write before planning


def shape(plan: str) -> dict[str, int | str]:
    pushed = sorted({p.rstrip(", ") for p in re.findall(r"PushedFilters: \[(.*?)(?:\]|\.\.\.)", plan) if p})
    return {
        "hash exch": plan.count("Exchange hashpartitioning"),
        "range exch": plan.count("Exchange rangepartitioning"),
        "broadcast": plan.count("BroadcastExchange"),
        "SMJ": plan.count("SortMergeJoin"),
        "partial agg": plan.count("partial_"),
        "sort agg": plan.count("SortAggregate"),
        "python": plan.count("ArrowEvalPython"),
        "top-k": plan.count("TakeOrderedAndProject"),
        "window": plan.count("Window "),
        "nested loop": plan.count("NestedLoopJoin") + plan.count("CartesianProduct"),
        "pushed filters": "; ".join(pushed)[:120],
    }


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    from larder.plans import registry
    from larder.session import get_session, scratch_path
    from larder.sources.driver import DriverTables
    from larder.sources.tables import read_tables, write_tables

    spark = get_session("local[8]", shuffle_partitions=16)
    spark.sparkContext.setLogLevel("ERROR")
    registry.queries()
    root = scratch_path(spark, "plans")
    write_tables(DriverTables(spark, sf_dir).as_dict(), root, 0)
    tables = DriverTables(spark, sf_dir).use(read_tables(spark, root, version=0))
    cols = None
    for name, q in registry.REGISTRY.items():
        if name in SKIP:
            continue
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            q.build(tables).explain()
        s = shape(buf.getvalue())
        if cols is None:
            cols = list(s)
            print("| query | " + " | ".join(cols) + " |")
            print("| --- " * (len(cols) + 1) + "|")
        print(f"| {name} | " + " | ".join(str(s[c]) for c in cols) + " |")
    spark.stop()


if __name__ == "__main__":
    main()
