"""Time the headline queries on BENCH_SF_DIR with BENCH_CPUS cores and print one JSON line.

All queries run once to warm up and then BENCH_RUNS times, in another order each time; a query's time is its best.
Results are computed in full and discarded.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from keysift.plans.queries import QUERIES

HEADLINE = (
    "rule_scan",  # 56 rules on every line
    "line_context",  # the same with names and 20 lines of context
    "rule_name_assignment",  # the costliest pattern, with nothing before it
    "entropy_findings",  # entropy on web pages
    "patch_rule_scan",  # all rules on the added lines of a patch log
    "first_commit_per_secret",  # the same, deduplicated
    "dedup_findings",  # the whole audit: files, patches and stashes, rules and entropy
    "stats_by_risk",  # its statistics
    "top_findings",  # its ten gravest findings
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("keysift-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, list[float]] = {name: [] for name in HEADLINE}
    for turn in range(runs + 1):
        at = turn * 4 % len(HEADLINE)
        for name in HEADLINE[at:] + HEADLINE[:at]:
            started = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name].append(time.perf_counter() - started)
    seconds = {name: round(min(taken[1:]), 3) for name, taken in times.items()}
    for name, taken in times.items():
        print(name, [round(t, 2) for t in taken], file=sys.stderr)
    print(json.dumps({"metric": "headline query time", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
