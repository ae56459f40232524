"""Trend counts as a stream.

The state is one counter per cluster and day. Windows of 30 days are sums of those, made when they are read, so a
ticket updates one counter and not thirty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.trends import rolling_counts
from .. import fixed_values as V


def daily_stream(rows: DataFrame, key: str, ts: str, lateness: str = "1 day") -> DataFrame:
    """(key, day, tickets) of a stream; a day is final once the watermark has passed it."""
    marked = rows.withWatermark(ts, lateness)
    counts = marked.groupBy(F.window(ts, "1 day"), key).agg(F.count("*").alias("tickets"))
    return counts.select(key, F.to_date("window.start").alias("day"), "tickets")


def window_stream(rows: DataFrame, key: str, ts: str, days: int = V.WINDOW_DAYS, slide_days: int = 1, lateness: str = "1 day") -> DataFrame:
    """(key, window_start, window_end, tickets) of sliding windows, for consumers that need them from the stream itself."""
    marked = rows.withWatermark(ts, lateness)
    window = F.window(ts, f"{days} days", f"{slide_days} days")
    counts = marked.groupBy(window, key).agg(F.count("*").alias("tickets"))
    return counts.select(key, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "tickets")


def start_daily_counts(daily: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Keeps the changed days of every micro-batch under ``path``."""

    def store_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    writer = daily.writeStream.outputMode("update").foreachBatch(store_batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "30 seconds"})).start()


def current_daily(stored: DataFrame, key: str) -> DataFrame:
    """The last count written for every key and day."""
    return stored.groupBy(key, "day").agg(F.max_by("tickets", "batch_id").alias("tickets"))


def stream_trends(stored: DataFrame, key: str, days: int = V.WINDOW_DAYS) -> DataFrame:
    """Both windows and the trend for every key and day, from the stored daily counts."""
    return rolling_counts(current_daily(stored, key), key, days)
