"""Headline queries at one scale; prints one JSON line.

Each query is run RUNS times to the end (every row and column produced, none collected) and its best
time is kept.
"""

from __future__ import annotations

import json
import os
import sys
import time

from rivulet.plans.queries import QUERIES
from rivulet.session import local_session

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "2"))
HEADLINES = [
    "events_typed",
    "apply_outcomes",
    "outcome_counts",
    "stream_state",
    "stream_state_backfill",
    "stream_state_incremental",
    "stream_view",
    "vesting_wide",
    "streams_page",
    "streams_count",
    "failed_events_open",
    "position_history",
    "request_histogram",
    "gauge_last",
    "exposition_lines",
    "decode_raw_pages",
]


def timed(spark, name: str) -> float:
    begun = time.perf_counter()
    QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begun


def main() -> None:
    wanted = sys.argv[1:] or HEADLINES
    spark = local_session(CPUS, "rivulet-bench")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {name: round(min(timed(spark, name) for _ in range(RUNS)), 3) for name in wanted}
    scale = os.path.basename(FOLDER.rstrip("/")).removeprefix("sf")
    result = {
        "metric": "total of headline queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
    }
    if "stream_state" in times:
        log = QUERIES["events_typed"](spark, FOLDER).count()
        result["fold_events_per_sec"] = round(log / times["stream_state"])
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
