"""Time the queries of the library; prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores. After a query that
warms the engine up, each query runs BENCH_RUNS times; the median counts.
Results go to a no-op sink, so the driver is no part of the time. Every query
starts from the given tables; nothing one query builds is read by another.

The headline queries come first and make up ``value``; the others follow as
long as BENCH_SECONDS are not over, and are listed with their own total. Each
query's time goes to stderr as it ends.
"""

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from rolegrid.plans.catalog import QUERIES  # noqa: E402
from rolegrid.session import CLUSTER_DEFAULTS  # noqa: E402

HEADLINE = """normalized_postings clean_pages document_tags salary_profile search_tokens document_copies page_postings
 page_trim tag_stats source_stats list_filters list_page keyset_page page_boundaries text_search posting_json
 near_duplicates duplicate_groups canonical_pointers posting_upsert run_counters stale_sweep constraint_audit
 ingest_jobs""".split()


def main():
    begin = time.perf_counter()
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    seconds = float(os.environ.get("BENCH_SECONDS", "1300"))
    names = sys.argv[1:] or [*HEADLINE, *(n for n in QUERIES if n not in HEADLINE)]
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config(map=CLUSTER_DEFAULTS)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["salary_profile"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    took, left_out = {}, []
    for name in names:
        if time.perf_counter() - begin > seconds:
            left_out.append(name)
            continue
        times = []
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        took[name] = round(statistics.median(times), 3)
        print(f"{name} {took[name]}", file=sys.stderr, flush=True)
    headline = {n: t for n, t in took.items() if n in HEADLINE} or took
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(headline.values()), 3), "unit": "sec",
        "queries": headline, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
        "other_queries": {n: t for n, t in took.items() if n not in headline},
        "headline_left_out": [n for n in left_out if n in HEADLINE], "others_left_out": [n for n in left_out if n not in HEADLINE],
    }), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
