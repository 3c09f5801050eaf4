"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from vitalgrid.plans import catalog  # noqa: E402
from vitalgrid.session import local_session  # noqa: E402

HEADLINE = [
    "chart_buckets", "chart_rollup", "check_access", "metric_watchers", "visible_metrics", "threshold_breaches",
    "alert_fanout", "ingest_readings", "store_readings", "broadcast_fanout", "subscription_state", "rate_limit",
    "request_stats", "due_reminders", "missed_reminders", "toggle_takes", "medications_nested",
    "apply_permission_changes", "membership_state", "extract_fields", "parse_numbered_items", "surface_names",
    "scrub_pii", "drug_match", "broadcast_as_of",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, memory="12g")
    catalog.QUERIES["request_stats"](spark, folder).count()  # start the session's workers
    times: dict[str, float] = {}
    for name in HEADLINE:
        started = time.time()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - started, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
