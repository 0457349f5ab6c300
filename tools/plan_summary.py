"""Summarise the physical plan of every registered query: exchanges by kind,
joins by strategy, windows, aggregates, and per scan the columns read and the
filters pushed. Writes Markdown to stdout.

usage: python tools/plan_summary.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def summarise(plan: str) -> dict:
    count = lambda pat: len(re.findall(pat, plan))
    scans = []
    for line in plan.splitlines():
        if "FileScan" not in line:
            continue
        table = re.search(r"/([\w.-]+?)(?:\.parquet)?[,\]]", line)
        schema = re.search(r"ReadSchema: struct<(.*?)>$", line.strip())
        pushed = re.search(r"PushedFilters: \[(.*?)\]", line)
        scans.append(((table.group(1) if table else "?"),
                      schema.group(1).count(":") if schema else 0,
                      bool(pushed and pushed.group(1))))
    return {
        "hash_exchange": count(r"Exchange hashpartitioning"),
        "range_exchange": count(r"Exchange rangepartitioning"),
        "single_exchange": count(r"Exchange SinglePartition"),
        "round_robin": count(r"Exchange RoundRobinPartitioning"),
        "broadcast": count(r"BroadcastExchange"),
        "bhj": count(r"BroadcastHashJoin"),
        "smj": count(r"SortMergeJoin"),
        "shj": count(r"ShuffledHashJoin"),
        "bnlj": count(r"BroadcastNestedLoopJoin"),
        "window": count(r"\bWindow \["),
        "hash_agg": count(r"HashAggregate\("),
        "checkpoint_scan": count(r"Scan ExistingRDD|LogicalRDD|ExistingRDD"),
        "python": count(r"ArrowEvalPython|BatchEvalPython"),
        "scans": scans,
    }


def main() -> None:
    from qamill.plans.catalog import QUERIES
    from qamill.session import get_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = get_session("local[8]", 8)
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")  # untruncated ReadSchema
    print("| query | hash exch. | range exch. | single | broadcast | BHJ | SMJ | window | agg | "
          "checkpoint reads | python | scans (table:columns read) |")
    print("| --- | --- | --- | --- | --- | --- | --- | --- | --- | --- | --- | --- |")
    for name, fn in QUERIES.items():
        df = fn(spark, sf)
        plan = df._jdf.queryExecution().executedPlan().toString()
        s = summarise(plan)
        scans = ", ".join(f"{t}:{n}{'+filter' if f else ''}" for t, n, f in s["scans"])
        print(f"| {name} | {s['hash_exchange']} | {s['range_exchange']} | {s['single_exchange']} | "
              f"{s['broadcast']} | {s['bhj']} | {s['smj']} | {s['window']} | {s['hash_agg']} | "
              f"{s['checkpoint_scan']} | {s['python']} | {scans} |")


if __name__ == "__main__":
    main()
