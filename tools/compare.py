"""Runs registered queries against their SQL twins: python tools/compare.py [folder] [name ...]"""

from __future__ import annotations

import glob
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

from trendloom.plans.oracle import oracle  # noqa: E402
from trendloom.plans.queries import QUERIES  # noqa: E402
from trendloom.session import local_session  # noqa: E402


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]

    def plain(x):
        if x is None or (isinstance(x, float) and pd.isna(x)):
            return "NULL"
        return repr(float(x)) if isinstance(x, float) else str(x)

    return sorted(tuple(plain(x) for x in row) for row in frame.astype(object).itertuples(index=False))


def difference(spark_frame: pd.DataFrame, duck_frame: pd.DataFrame) -> str | None:
    if sorted(spark_frame.columns) != sorted(duck_frame.columns):
        return f"columns {sorted(spark_frame.columns)} / {sorted(duck_frame.columns)}"
    a, b = rows_of(spark_frame), rows_of(duck_frame)
    if len(a) != len(b):
        return f"rows {len(a)} / {len(b)}"
    for x, y in zip(a, b):
        if x != y:
            cells = [(c, u[:300], v[:300]) for c, u, v in zip(sorted(spark_frame.columns), x, y) if u != v]
            return f"first different row: {cells}"
    types = [
        f"{c} {spark_frame[c].dtype}/{duck_frame[c].dtype}" for c in spark_frame
        if spark_frame[c].dtype != duck_frame[c].dtype and len(a) and not spark_frame[c].isna().any()
    ]
    return f"types differ: {types}" if types else None


def main() -> None:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or list(QUERIES)
    spark, connection, twins = local_session(8), duck(folder), oracle()
    bad = 0
    for name in wanted:
        started = time.time()
        try:
            got = QUERIES[name](spark, folder).toPandas()
            seconds = time.time() - started
            if name not in twins:
                print(f"{name:28s} {seconds:6.1f}s rows {len(got)} (no SQL)")
                continue
            problem = difference(got, connection.execute(twins[name]).df())
        except Exception as error:  # report and go on with the next query
            problem, seconds = f"{type(error).__name__}: {str(error)[:1500]}", time.time() - started
        bad += problem is not None
        print(f"{name:28s} {seconds:6.1f}s {'ok' if problem is None else problem}", flush=True)
    print(f"{bad} of {len(wanted)} differ")


if __name__ == "__main__":
    main()
