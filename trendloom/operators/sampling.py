"""Stratified sample: the same share of every stratum, repeatable for a seed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import GROUP_LIMIT, top_per_group


def stratified_sample(rows: DataFrame, stratum: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """About equal numbers of every stratum, ``n`` rows in all (all rows if there are fewer).

    Each stratum gives its first ``n // strata + 1`` rows in the order of a seeded hash; what exceeds ``n`` is cut from
    the last round, so that the cut is even. There may be as many strata as rows.
    """
    hashed = rows.withColumn("_hash", F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))))
    sizes = rows.groupBy(stratum).agg(F.count("*").alias("size"))
    strata = sizes.count()
    if not strata or n <= 0:
        return rows.limit(0)
    per_stratum = n // strata + 1
    if per_stratum <= GROUP_LIMIT:
        picked = top_per_group(hashed, [stratum], [F.col("_hash")], per_stratum, "_round")
    else:
        picked = first_by_hash(hashed, stratum, per_stratum)
    if per_stratum == 1:
        return _least_hashes(picked, n).drop("_hash")
    # Rounds before the last always fit into n, so only the last one is cut. It has at most one row per stratum.
    room = n - sizes.agg(F.sum(F.least(F.col("size"), F.lit(per_stratum - 1)))).first()[0]
    last = F.col("_round") == per_stratum
    whole = picked.filter(~last).drop("_hash", "_round")
    return whole.unionByName(_least_hashes(picked.filter(last), room).drop("_hash"))


def _least_hashes(rows: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows of the least hashes, over all strata: found by ranges of hashes, never in one task."""
    return first_by_hash(rows.drop("_round").withColumn("_all", F.lit(0)), "_all", n).drop("_all", "_round")


def first_by_hash(hashed: DataFrame, stratum: str, n: int) -> DataFrame:
    """The first ``n`` rows of each stratum by hash with their ``_round``, for any ``n``.

    Hash prefixes cut every stratum into small ranges. Their counts say which ranges lie below ``n`` and where each
    starts, so a hot stratum is ranked range by range and never in one task.
    """
    prefixed = hashed.withColumn("_range", F.substring("_hash", 1, 4))
    counts = prefixed.groupBy(stratum, "_range").count()
    before = Window.partitionBy(stratum).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("count").over(before), F.lit(0))).filter(F.col("_start") < n)
    joined = prefixed.alias("r").join(
        starts.alias("s"), F.col(f"r.{stratum}").eqNullSafe(F.col(f"s.{stratum}")) & F.col("r._range").eqNullSafe(F.col("s._range"))
    )
    ranked = joined.select(
        "r.*", (F.col("s._start") + F.row_number().over(
            Window.partitionBy(f"r.{stratum}", "r._range").orderBy("r._hash")
        )).alias("_round")
    )
    return ranked.filter(F.col("_round") <= n).drop("_range")
