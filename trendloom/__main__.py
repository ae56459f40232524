"""Batch jobs from the command line, for spark-submit."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.dates import instant
from .plans.ingest import ingest_csv, seed_dataset
from .plans.recluster import assign_new, recluster
from .session import CLUSTER_SETTINGS
from .sources.store import TicketStore


def main() -> None:
    parser = argparse.ArgumentParser(prog="trendloom")
    parser.add_argument("--store", required=True, help="folder of the stored tables")
    parser.add_argument("--as-of", help="ISO time that counts as now")
    jobs = parser.add_subparsers(dest="job", required=True)
    ingest = jobs.add_parser("ingest", help="read, clean, embed and upsert CSV tickets")
    ingest.add_argument("--file", required=True)
    ingest.add_argument("--month", help="YYYY-MM that all dates are moved into")
    ingest.add_argument("--mode", choices=("recluster", "assign"), default="recluster")
    again = jobs.add_parser("recluster", help="rebuild all clusters")
    again.add_argument("--k", type=int)
    again.add_argument("--keep-ids", action="store_true")
    seed = jobs.add_parser("seed", help="store a stratified sample of the support dataset")
    seed.add_argument("--dataset", required=True)
    seed.add_argument("--n", type=int, default=500)
    seed.add_argument("--k", type=int, default=7)
    seed.add_argument("--skip-truncate", action="store_true")
    args = parser.parse_args()

    builder = SparkSession.builder.appName("trendloom")
    for key, value in CLUSTER_SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    store = TicketStore(spark, args.store)
    as_of = instant(args.as_of) if args.as_of else F.current_timestamp()
    if args.job == "ingest":
        print(ingest_csv(spark, store, args.file, as_of, args.month))
        if args.mode == "recluster":
            recluster(store, as_of)
        else:
            assign_new(store, as_of)
    elif args.job == "recluster":
        recluster(store, as_of, k=args.k, keep_ids=args.keep_ids)
    else:
        seed_dataset(spark, store, args.dataset, as_of, args.n, truncate=not args.skip_truncate)
        recluster(store, as_of, k=args.k)


if __name__ == "__main__":
    main()
