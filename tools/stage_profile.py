"""Run one query with Spark's event log in a fresh scratch folder and print
per-stage wall time, task count and summed executor CPU / GC time.

usage: python tools/stage_profile.py QUERY [sf_dir] [repeat]
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main() -> None:
    from pyspark.sql import SparkSession
    name = sys.argv[1]
    sf_dir = sys.argv[2] if len(sys.argv) > 2 else "/root/testdata/sf0.1"
    repeat = int(sys.argv[3]) if len(sys.argv) > 3 else 2
    logdir = tempfile.mkdtemp(prefix="evlog-", dir="/tmp")
    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", f"file://{logdir}")
             .config("spark.eventLog.compress", "false")
             .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "16g")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from qamill.plans.catalog import QUERIES
    from qamill.session import configure
    configure(spark)
    for _ in range(repeat):
        t0 = time.perf_counter()
        spark.sparkContext.setJobGroup("run", "run")
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        print(f"run {time.perf_counter() - t0:.3f}s")
    spark.stop()
    files = [f for f in glob.glob(f"{logdir}/**/events_*", recursive=True) if os.path.isfile(f)]
    stages, cpu = {}, {}
    for f in files:
        for line in open(f):
            e = json.loads(line)
            if e["Event"] == "SparkListenerStageCompleted":
                si = e["Stage Info"]
                stages[si["Stage ID"]] = (si["Stage Name"][:40], si["Number of Tasks"],
                                          si["Completion Time"] - si["Submission Time"])
            elif e["Event"] == "SparkListenerTaskEnd":
                m = e.get("Task Metrics") or {}
                a = cpu.setdefault(e["Stage ID"], [0, 0.0, 0, 0])
                a[0] += m.get("Executor Run Time", 0)
                a[1] += m.get("Executor CPU Time", 0) / 1e6
                a[2] += m.get("JVM GC Time", 0)
                a[3] = max(a[3], m.get("Executor Run Time", 0))
    for sid in sorted(stages)[-40:]:
        n, tasks, wall = stages[sid]
        r = cpu.get(sid, [0, 0, 0, 0])
        print(f"stage {sid:3d} tasks={tasks:3d} wall={wall:5d}ms run={r[0]:6d}ms "
              f"max_task={r[3]:5d}ms cpu={int(r[1]):6d}ms gc={r[2]:4d}ms  {n}")


if __name__ == "__main__":
    main()
