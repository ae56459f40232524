"""Dashboard roll-ups over the cluster table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import segment, segment_order, slug
from ..functions.trend import half_up


def kpis(clusters: DataFrame) -> DataFrame:
    return clusters.agg(
        F.coalesce(F.sum("ticket_count"), F.lit(0)).cast("bigint").alias("total_tickets"),
        F.count("*").alias("clusters"),
        F.count_if(F.col("trend") == "Increasing").alias("increasing"),
        F.count_if(F.col("trend") == "Decreasing").alias("decreasing"),
    )


def segment_trends(clusters: DataFrame) -> DataFrame:
    """Previous and current tickets per segment, in the fixed segment order."""
    sums = clusters.groupBy(segment(F.col("name")).alias("segment")).agg(
        F.sum("prev_window_count").alias("prev"), F.sum("curr_window_count").alias("curr")
    )
    return sums.withColumn("position", segment_order(F.col("segment"))).orderBy("position")


def segment_shares(clusters: DataFrame) -> DataFrame:
    """Tickets per segment with the whole percent of all tickets, in the fixed segment order."""
    sums = clusters.groupBy(segment(F.col("name")).alias("segment")).agg(F.sum("ticket_count").alias("tickets"))
    total = F.sum("tickets").over(Window.partitionBy())  # at most one row per segment
    percent = F.when(total > 0, half_up(F.col("tickets") / total * 100)).otherwise(0)
    shares = sums.select("segment", slug(F.col("segment")).alias("key"), "tickets", percent.alias("pct"))
    return shares.withColumn("position", segment_order(F.col("segment"))).orderBy("position")
