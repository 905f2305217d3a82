"""Time the headline queries: one warm-up, then the median of the runs, each into the noop sink."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from postloom.plans import catalog  # noqa: E402
from postloom.session import local_session  # noqa: E402

HEADLINES = [
    "keyword_quality",
    "latest_status",
    "new_postings",
    "title_cache_lookup",
    "salary_range",
    "remove_pii",
    "funnel_by_owner",
    "usage_summary",
    "search_page_by_score",
    "applied_with_status",
    "save_counts",
    "reconcile_logs",
    "attach_title_scores",
    "clearance_flag",
    "redact",
    "page_text",
    "result_scores",
    "upsert_cache",
    "retention_history",
    "write_back",
    "board_indeed",
    "board_linkedin",
    "board_zip_recruiter",
    "board_marriott",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINES
    spark = local_session(cores)
    queries = catalog.runnable()
    seconds = {}
    for name in names:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken[1:]), 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, sum of medians",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
