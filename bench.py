"""Times the headline queries and prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose tables and cores.

Every query runs ``RUNS`` times in a row: ``first`` has its first run, with planning and compilation, ``warm`` the
median of the others, and ``queries`` and ``value`` the median of all.
"""

from __future__ import annotations

import json
import os
import time
from statistics import median

from pyspark.sql import SparkSession

from sedge.plans.queries import QUERIES

HEADLINE = ("distinct_edges", "pair_counts_lex", "pair_counts_numeric", "max_pair", "topk_lex", "topk_numeric", "topk_with_shared", "topk_numeric_with_shared", "topk_ties_lex", "community_counts")
RUNS = 3


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["shared_suppliers"](spark, sf_dir).count()  # the session's first job pays for its start
    took = {}
    for name in HEADLINE:
        took[name] = []
        for _ in range(RUNS):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took[name].append(time.perf_counter() - began)
    spark.stop()
    queries = {n: round(median(x), 3) for n, x in took.items()}
    rest = {"first": {n: round(x[0], 3) for n, x in took.items()}, "warm": {n: round(median(x[1:]), 3) for n, x in took.items()}}
    print(json.dumps({"metric": "headline queries, median of 3 runs, total", "value": round(sum(queries.values()), 3), "unit": "sec", "queries": queries, **rest, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
