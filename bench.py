"""Benchmark: headline queries over one data folder, one JSON line on stdout.

BENCH_SF_DIR   data folder, default /root/testdata/sf0.1
BENCH_CPUS     local cores, default 8
BENCH_RUNS     timed runs per query after one warm-up, default 2 (the median counts)
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from forgeline.plans.catalog import QUERIES  # noqa: E402
from forgeline.session import local_session  # noqa: E402

HEADLINE = [
    "regression_pairs",
    "inducing_commits",
    "file_ownership",
    "top_paths",
    "file_experts",
    "contributor_activity",
    "latest_owner_pairs",
    "primary_owner_pairs",
    "duplicate_positive_pairs",
    "duplicate_negative_pairs",
    "assignment_pairs",
    "ci_actor_failure_rates",
    "ci_workflow_failures",
    "breakage_cause_pairs",
    "review_time_pairs",
    "issue_records",
    "pull_request_records",
    "issue_thread_text",
    "discussion_thread_text",
    "classified_threads",
    "review_queue",
    "review_statistics",
    "review_export",
    "running_ci_counters",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)

    def once(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in HEADLINE:
        once(name)  # warm-up
        seconds[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
