"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR selects the data (default sf0.1), BENCH_CPUS the cores (default 8), BENCH_RUNS the
warm runs per query, of which the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from suite import registered
from verify import session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
HEADLINE = (
    "column_profile_lineitem", "duplicate_rows", "correlation_pairs", "histogram_events",
    "referential_integrity", "meta_features", "audit_summary", "issues",
)


def main() -> None:
    spark = session(CPUS)
    queries, _ = registered()
    taken = {}
    for name in HEADLINE:
        times = []
        for i in range(RUNS + 1):
            start = time.perf_counter()
            queries[name](spark, SF_DIR).collect()
            if i:  # the first run warms up
                times.append(time.perf_counter() - start)
        taken[name] = round(statistics.median(times), 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(taken.values()), 3), "unit": "sec",
        "queries": taken, "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1], "cpus": int(CPUS),
    }))


if __name__ == "__main__":
    main()
