"""Per-group first rows and whole-table numbering, safe for hot groups.

A row-number filter with a small bound is applied by Spark before the shuffle as well (every task keeps at most the
bound per group), so a group that holds a third of the table still sends only a few rows per task. For larger bounds
the rank is found from a histogram, see ``sampling``.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GROUP_PARTS = 64
GROUP_LIMIT = 1000  # spark.sql.optimizer.windowGroupLimitThreshold: up to here the filter runs before the shuffle


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group with their rank; the order must be total.

    Beyond the bound the first ``n`` of each of some parts of a group are found first, so that one task never gets more
    of a group than these.
    """
    if n > GROUP_LIMIT:
        parts = df.withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.lit(GROUP_PARTS)))
        inside = Window.partitionBy(*keys, "_part").orderBy(*order)
        df = parts.withColumn("_place", F.row_number().over(inside)).filter(F.col("_place") <= n).drop("_part", "_place")
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)


def first_per_group(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_per_group(df, keys, order, 1, "_rank").drop("_rank")


def last_per_id(df: DataFrame, key: str = "ticket_id", seq: str = "seq") -> DataFrame:
    """Deduplicate a batch: of rows with one id the last in input order stays."""
    return first_per_group(df, [key], [F.col(seq).desc()])


def numbered(df: DataFrame, key: str, name: str, start: int, buckets: int = 4096) -> DataFrame:
    """Consecutive numbers from ``start`` in the order of a unique numeric column, without one global sort; rows
    without a value come last.

    Approximate quantiles cut the column into buckets; each bucket is numbered on its own and moved by the exact count
    of the buckets before it. The cut points are a constant of the plan, so a recomputed task gives the same numbers.
    """
    cuts = sorted(set(df.stat.approxQuantile(key, [i / buckets for i in range(1, buckets)], 1 / buckets)))
    edges = [float("-inf"), *cuts, float("inf")]
    split = Bucketizer(splits=edges, inputCol="_key", outputCol="_bucket")
    bucketed = split.transform(df.withColumn("_key", F.col(key).cast("double"))).drop("_key")
    # Rows without a key come last, spread by a hash of the row: there may be any number of them.
    row_hash = F.xxhash64(*df.columns)
    without = F.lit(float(len(edges))) + F.pmod(row_hash, F.lit(buckets))
    bucketed = bucketed.withColumn("_bucket", F.coalesce("_bucket", without))
    counts = bucketed.groupBy("_bucket").count()
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    offsets = counts.select("_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(key, row_hash))
    return (
        bucketed.withColumn("_row", inside)
        .join(F.broadcast(offsets), "_bucket")  # at most twice `buckets` rows
        .withColumn(name, F.col("_offset") + F.col("_row") - 1 + start)
        .drop("_bucket", "_row", "_offset")
    )
