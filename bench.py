"""Time the headline queries and print one JSON line.

Reads the tables in $BENCH_SF_DIR on local[$BENCH_CPUS]; every query is run to completion without keeping its rows.
"""

from __future__ import annotations

import json
import os
import re
import time

from weekspan.catalog import load
from weekspan.session import local_session

HEADLINE = [
    "stage1_dataset",
    "user_summary",
    "weekly_features",
    "stage2_dataset",
    "dropout_labels",
    "seq_no_summer",
    "seq_fixed",
    "split_by_users",
    "outcome_by_cluster_group",
    "chi_square",
    "adjusted_rand",
    "roc_auc",
    "threshold_sweep",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = local_session(cores, shuffle_partitions=int(cores))
    queries, _ = load()
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executors
    seconds: dict[str, float] = {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else folder,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
