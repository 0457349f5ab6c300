"""Benchmark the headline queries.

Runs each query to completion (a no-op sink: every row is computed, nothing is
shipped to the driver) on ``local[$BENCH_CPUS]`` over ``$BENCH_SF_DIR`` and
prints one JSON line. Each query runs ``$BENCH_REPEAT`` times in one
warm session; the median run is reported (default 3).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from qamill.plans.catalog import QUERIES  # noqa: E402
from qamill.session import get_session  # noqa: E402

HEADLINE = [
    "run_summary", "group_advantage", "score_details", "check_answer", "reward_by_prompt",
    "report_grouped", "experiment_matrix", "vocab", "token_ids", "sft_examples", "batch_pad",
    "chat_render", "extract_last_number", "option_merge", "run_names",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = get_session(f"local[{cpus}]", cpus)
    # warm the JVM and the parquet footers once
    QUERIES["run_summary"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        runs = []
        for _ in range(repeat):
            t0 = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(runs), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": cpus,
                      "repeat": repeat}))
    spark.stop()


if __name__ == "__main__":
    main()
