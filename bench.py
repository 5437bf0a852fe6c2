"""Seconds per headline query over whole sample tables, as one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))

from runledger.plans.catalog import queries  # noqa: E402
from runledger.session import build_session  # noqa: E402

HEADLINE = (
    "task_search_page", "runs_by_weekday_hour", "run_status_matrix", "run_calendar", "queue_admission", "dispatch_plan",
    "status_fold", "bulk_job_validation", "job_list", "job_detail", "audit_trail", "lookup_tree", "operator_actions",
    "upsert_definitions", "payload_flatten", "payload_build", "notification_feed", "stream_status_fold",
)


def seconds(run) -> float:
    started = time.perf_counter()
    run().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "runledger-bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus if cpus.isdigit() else "8",
        spark__driver__memory="8g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    known, timed = queries(), {}
    for name in HEADLINE:
        # The first run pays for class loading and code generation; the second is kept.
        seconds(lambda: known[name](spark, folder))
        timed[name] = round(seconds(lambda: known[name](spark, folder)), 3)
    total = round(sum(timed.values()), 3)
    scale = os.path.basename(os.path.normpath(folder)).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": timed, "sf": scale}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
