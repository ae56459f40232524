"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the local cores. Every query is run to its last row (a ``noop`` write)
once to warm up and then BENCH_RUNS times; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from trendloom.plans.queries import QUERIES  # noqa: E402
from trendloom.session import local_session  # noqa: E402

HEADLINE = (
    "cluster_trends", "order_trends_closed", "event_rolling_trends", "month_view", "order_month_view", "refresh_trends",
    "cluster_listing", "cluster_examples", "distinct_examples", "cluster_search", "segment_share", "clean_tickets",
    "stable_ids", "dedupe_last", "stratified_sample_large", "sequential_ids", "upsert_tickets", "constraint_report",
    "nearest_centroid", "similar_topk", "month_listing", "lloyd_3", "kmeans_euclidean", "recluster", "text_vectors",
    "term_names", "alert_rows", "csv_ingest", "json_tickets", "stream_ingest", "stream_daily_trends",
)


def seconds(spark, name: str, folder: str) -> float:
    started = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus, runs = os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_RUNS", "1"))
    spark = local_session(cpus, **{"spark.sql.shuffle.partitions": cpus, "spark.ui.showConsoleProgress": "false"})
    times = {}
    for name in HEADLINE:
        seconds(spark, name, folder)
        times[name] = round(statistics.median(seconds(spark, name, folder) for _ in range(runs)), 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
