"""Stage and task times of registered queries, from Spark's event log.

Usage: python scripts/stage_times.py SF_DIR QUERY [QUERY ...]

The four tables are loaded as parquet once (as bench.py does).  Each query
then runs twice with the event log written to a fresh folder under /tmp, and
the second (warm) run is summarised: its jobs, and each job's stages with
task count and duration in milliseconds.  No UI or REST endpoint is used.
"""

from __future__ import annotations

import io
import json
import os
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def summarise(log_dir: str) -> None:
    import zstandard

    jobs, stages = {}, {}
    for base, _, files in os.walk(log_dir):
        for name in files:
            if not name.startswith("events_"):
                continue
            fh = open(os.path.join(base, name), "rb")
            raw = zstandard.ZstdDecompressor().stream_reader(fh) if name.endswith(".zstd") else fh
            for line in io.TextIOWrapper(raw, encoding="utf-8"):
                e = json.loads(line)
                ev = e["Event"]
                if ev == "SparkListenerJobStart":
                    group = (e.get("Properties") or {}).get("spark.jobGroup.id")
                    jobs[e["Job ID"]] = [group, e["Submission Time"], None, e["Stage IDs"]]
                elif ev == "SparkListenerJobEnd":
                    jobs[e["Job ID"]][2] = e["Completion Time"]
                elif ev == "SparkListenerStageCompleted":
                    si = e["Stage Info"]
                    if "Completion Time" in si and "Submission Time" in si:
                        stages[si["Stage ID"]] = (si["Number of Tasks"], si["Completion Time"] - si["Submission Time"])
    total: dict[str, int] = {}
    for jid, (group, start, end, sids) in sorted(jobs.items()):
        if not group or not group.endswith("#warm"):
            continue
        ms = (end or start) - start
        total[group] = total.get(group, 0) + ms
        detail = ", ".join(f"stage {s}: {stages[s][0]} tasks {stages[s][1]} ms" for s in sids if s in stages)
        print(f"{group[:-5]:32s} job {jid:4d} {ms:6d} ms  [{detail}]")
    for group, ms in total.items():
        print(f"{group[:-5]:32s} total {ms} ms in jobs")


def main() -> None:
    sf_dir, names = sys.argv[1], sys.argv[2:]
    from larder.plans import registry
    from larder.session import get_session, scratch_path
    from larder.sources.driver import DriverTables
    from larder.sources.tables import read_tables, write_tables

    log_dir = tempfile.mkdtemp(prefix="larder-eventlog-")
    spark = get_session("local[8]", shuffle_partitions=8,
                        extra_conf={"spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir})
    spark.sparkContext.setLogLevel("ERROR")
    registry.queries()
    root = scratch_path(spark, "stage-times")
    write_tables(DriverTables(spark, sf_dir).as_dict(), root, 0)
    tables = DriverTables(spark, sf_dir).use(read_tables(spark, root, version=0))
    for name in names:
        for tag in ("cold", "warm"):
            spark.sparkContext.setJobGroup(f"{name}#{tag}", name)
            t0 = time.perf_counter()
            registry.REGISTRY[name].build(tables).write.format("noop").mode("overwrite").save()
            print(f"{name} {tag} {time.perf_counter() - t0:.3f} s")
    spark.stop()
    summarise(log_dir)


if __name__ == "__main__":
    main()
