"""Command line: ``python -m larder <command>`` (run through spark-submit on a cluster).

  load    --csv-dir D --root R              raw CSVs -> clean -> audit -> version 0 under R
  report  --root R --out O [--as-of DATE]   every dashboard panel as parquet under O
  query   NAME --sf-dir D --out O           one registered query over driver tables -> parquet
  list                                      names of the registered queries
"""

from __future__ import annotations

import argparse
import datetime as dt


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="larder")
    ap.add_argument("--master", default=None, help="Spark master (default: from spark-submit)")
    sub = ap.add_subparsers(dest="cmd", required=True)
    p = sub.add_parser("load")
    p.add_argument("--csv-dir", required=True)
    p.add_argument("--root", required=True)
    p = sub.add_parser("report")
    p.add_argument("--root", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--as-of", default=None)
    p = sub.add_parser("query")
    p.add_argument("name")
    p.add_argument("--sf-dir", required=True)
    p.add_argument("--out", required=True)
    sub.add_parser("list")
    args = ap.parse_args(argv)

    from larder.plans import registry

    if args.cmd == "list":
        registry.queries()
        print("\n".join(registry.REGISTRY))
        return

    from larder.session import get_session

    spark = get_session(args.master, cluster=args.master is None)
    if args.cmd == "load":
        from larder.plans.etl import load_from_csv

        load_from_csv(spark, args.csv_dir, args.root)
    elif args.cmd == "report":
        from larder.plans import catalog
        from larder.sources.tables import read_tables

        as_of = dt.date.fromisoformat(args.as_of) if args.as_of else dt.date.today()
        tables = read_tables(spark, args.root)
        catalog.refresh(catalog.dashboard(tables, as_of), catalog.parquet_sink(args.out))
    elif args.cmd == "query":
        df = registry.queries()[args.name](spark, args.sf_dir)
        df.write.mode("overwrite").parquet(args.out)


if __name__ == "__main__":
    main()
