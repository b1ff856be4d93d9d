"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the input folder, ``BENCH_CPUS`` the local threads, ``BENCH_QUERIES`` (comma separated)
replaces the default selection, ``all`` runs everything. The ingest step, on which all queries depend, is part of the sum. Each query is planned
and run from scratch once to warm up and then ``BENCH_RUNS`` times; the median counts. Results are written to a
no-op sink, so every row and column is computed.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from frostline.plans.catalogue import queries
from frostline.plans.workspace import tables

HEADLINE = (
    "billable_clears", "receivables_by_contract", "invoice_run", "invoice_line_items", "invoices_outstanding",
    "clears_planned", "clears_today", "clears_upcoming", "sites_uncleared", "sla_at_risk", "storms_open",
    "needs_location", "payouts_due", "payouts_missing", "payout_run", "operator_activity", "mileage_by_month",
    "sla_outcome", "storm_recap", "dq_violations", "storm_open_clears", "outbox_events", "clears_with_results",
    "clears_moved_day", "notes_leak_scan", "stream_punch_match", "stream_sla_alerts",
)


def session(cpus: str) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("frostline-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(max(int(cpus), 4)) if cpus.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def timed(work) -> float:
    start = time.perf_counter()
    work()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    catalogue = queries()
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(catalogue) if wanted == "all" else [n for n in wanted.split(",") if n] or list(HEADLINE)
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    ingest = timed(lambda: tables(spark, folder))
    seconds: dict[str, float] = {}
    for name in names:
        def run() -> None:
            catalogue[name](spark, folder).write.format("noop").mode("overwrite").save()

        run()
        seconds[name] = round(statistics.median(timed(run) for _ in range(runs)), 3)
    print(json.dumps({
        "metric": "ingest and median seconds per query, summed", "value": round(ingest + sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "ingest_sec": round(ingest, 3), "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
