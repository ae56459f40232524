"""Window counts per cluster, trend labels, refresh, month view."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.dates import days_before, in_month, month_start
from ..functions.trend import percent_text, share_of, trend_label

RULES = ("rolling", "rolling_closed", "split", "month")


def windows(ts: Column, as_of: Column | None, rule: str = "rolling_closed", days: int = V.WINDOW_DAYS, month: str | None = None):
    """(previous, current) conditions on a timestamp.

    rolling         the last ``days`` and the ``days`` before them
    rolling_closed  the same, without tickets dated after ``as_of``
    split           everything older than ``days`` against the rest
    month           a calendar month against the one before
    """
    if rule == "month":
        return in_month(ts, month, -1), in_month(ts, month)
    if rule not in RULES:
        raise ValueError(f"unknown window rule {rule!r}")
    middle, start = days_before(as_of, days), days_before(as_of, 2 * days)
    prev, curr = ts < middle, ts >= middle
    if rule != "split":
        prev = (ts >= start) & prev
    if rule == "rolling_closed":
        curr = curr & (ts <= as_of)
    return prev, curr


def _scan_range(ts: Column, as_of: Column | None, rule: str, days: int, month: str | None) -> Column | None:
    """The span both windows cover, as plain bounds on the column that reach the scan."""
    if rule == "month":
        return (ts >= F.lit(month_start(month, -1))) & (ts < F.lit(month_start(month, 1)))
    if rule == "split":
        return None
    span = ts >= days_before(as_of, 2 * days)
    return span & (ts <= as_of) if rule == "rolling_closed" else span


def count_windows(
    rows: DataFrame, key: str, ts: str, as_of: Column | None = None, rule: str = "rolling_closed",
    days: int = V.WINDOW_DAYS, month: str | None = None,
) -> DataFrame:
    """Rows per key in the previous and in the current window; keys without rows in either are left out."""
    span = _scan_range(F.col(ts), as_of, rule, days, month)
    prev, curr = windows(F.col(ts), as_of, rule, days, month)
    ranged = rows if span is None else rows.filter(span)
    return ranged.groupBy(key).agg(
        F.count_if(prev).alias("prev_window_count"), F.count_if(curr).alias("curr_window_count")
    )


def member_windows(members: DataFrame, tickets: DataFrame, **window) -> DataFrame:
    """Window counts per cluster. Only ids and dates of tickets inside the windows meet the members."""
    dated = tickets.select(F.col("id").alias("ticket_id"), "created_at")
    span = _scan_range(
        F.col("created_at"), window.get("as_of"), window.get("rule", "rolling_closed"),
        window.get("days", V.WINDOW_DAYS), window.get("month"),
    )
    dated = dated if span is None else dated.filter(span)
    joined = members.select("ticket_id", "cluster_id").join(dated, "ticket_id")
    return count_windows(joined, "cluster_id", "created_at", **window)


def member_totals(members: DataFrame) -> DataFrame:
    return members.groupBy("cluster_id").agg(F.count("*").alias("ticket_count"))


def cluster_trends(clusters: DataFrame, members: DataFrame, tickets: DataFrame, **window) -> DataFrame:
    """Counts, trend and percent change of every cluster, most tickets first. An empty cluster has zeros."""
    counts = member_windows(members, tickets, **window)
    named = clusters.select(F.col("id").alias("cluster_id"), "name")
    joined = named.join(member_totals(members), "cluster_id", "left").join(counts, "cluster_id", "left")
    zeros = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("ticket_count", "prev_window_count", "curr_window_count")}
    return with_trend(joined.withColumns(zeros)).orderBy(F.col("ticket_count").desc(), "cluster_id")


def with_trend(counts: DataFrame) -> DataFrame:
    prev, curr = F.col("prev_window_count"), F.col("curr_window_count")
    return counts.withColumns({"trend": trend_label(prev, curr), "pct_change": percent_text(prev, curr)})


def with_shares(clusters: DataFrame) -> DataFrame:
    """The share of each window in all tickets of the cluster, for its bars."""
    total = F.col("ticket_count")
    return clusters.withColumns(
        {"prev_share": share_of(F.col("prev_window_count"), total), "curr_share": share_of(F.col("curr_window_count"), total)}
    )


def refresh_trends(clusters: DataFrame, members: DataFrame, tickets: DataFrame, as_of: Column, stale: str = "zero", **window) -> DataFrame:
    """The clusters with counts, trend and time brought up to date.

    A cluster without members gets zeros, or keeps its stored numbers with ``stale='keep'``.
    """
    totals = member_totals(members).withColumnRenamed("ticket_count", "_total")
    counts = member_windows(members, tickets, as_of=as_of, **window).withColumnsRenamed(
        {"prev_window_count": "_prev", "curr_window_count": "_curr"}
    )
    joined = clusters.join(totals.join(counts, "cluster_id", "left"), clusters["id"] == totals["cluster_id"], "left")
    has_members = F.col("_total").isNotNull()
    update = has_members if stale == "keep" else F.lit(True)

    def renewed(new: Column, name: str) -> Column:
        return F.when(update, new).otherwise(F.col(name))

    prev, curr = F.coalesce(F.col("_prev"), F.lit(0)), F.coalesce(F.col("_curr"), F.lit(0))
    new_values = {
        "ticket_count": F.coalesce(F.col("_total"), F.lit(0)).cast("int"),
        "prev_window_count": prev.cast("int"),
        "curr_window_count": curr.cast("int"),
        "trend": trend_label(prev, curr),
        "updated_at": as_of,
    }
    return joined.select(
        *[renewed(new_values[c], c).alias(c) if c in new_values else F.col(c) for c in clusters.columns]
    )


def month_view(clusters: DataFrame, members: DataFrame, tickets: DataFrame, month: str) -> DataFrame:
    """Clusters with tickets in the month: their count in it, in the month before, and the trend between the two."""
    counts = member_windows(members, tickets, rule="month", month=month).filter(F.col("curr_window_count") > 0)
    named = clusters.select(F.col("id").alias("cluster_id"), "name", "description")
    view = with_trend(named.join(counts, "cluster_id")).withColumn("ticket_count", F.col("curr_window_count"))
    return view.orderBy(F.col("ticket_count").desc(), "cluster_id")


def members_in_month(members: DataFrame, tickets: DataFrame, month: str) -> DataFrame:
    inside = tickets.filter(in_month(F.col("created_at"), month)).select(F.col("id").alias("ticket_id"))
    return members.join(inside, "ticket_id", "left_semi")


def month_calendar(tickets: DataFrame, as_of: datetime, months: int = V.MONTHS_LISTED) -> DataFrame:
    """The last months with their number of tickets, zero included, and a row for all time."""
    last = as_of.strftime("%Y-%m")
    first = month_start(last, 1 - months)
    start = F.trunc(F.col("created_at"), "month").cast("timestamp")
    per_month = tickets.groupBy(start.alias("month_start")).agg(F.count("*").alias("tickets"))
    spark = tickets.sparkSession
    listed = spark.range(months).select(
        F.add_months(F.lit(first.date()), F.col("id").cast("int")).cast("timestamp").alias("month_start")
    )
    rows = listed.join(per_month, "month_start", "left").select(
        F.date_format("month_start", "yyyy-MM").alias("value"),
        F.date_format("month_start", "MMMM yyyy").alias("label"),
        F.coalesce("tickets", F.lit(0)).alias("tickets"),
    )
    everything = per_month.agg(F.coalesce(F.sum("tickets"), F.lit(0)).alias("tickets")).select(
        F.lit("all").alias("value"), F.lit("All Time").alias("label"), "tickets"
    )
    return everything.unionByName(rows)


def daily_counts(rows: DataFrame, key: str, ts: str) -> DataFrame:
    return rows.groupBy(key, F.to_date(ts).alias("day")).agg(F.count("*").alias("tickets"))


def rolling_counts(daily: DataFrame, key: str, days: int = V.WINDOW_DAYS) -> DataFrame:
    """For every key and day with tickets: those of the last ``days`` days and of the ``days`` before.

    Works on one row per key and day, so a row of the source is counted once and not once per window.
    """
    from pyspark.sql import Window

    number = F.unix_date("day")
    by_day = Window.partitionBy(key).orderBy(number)
    curr = F.sum("tickets").over(by_day.rangeBetween(1 - days, 0))
    prev = F.coalesce(F.sum("tickets").over(by_day.rangeBetween(1 - 2 * days, -days)), F.lit(0))
    rows = daily.select(key, "day", prev.alias("prev_window_count"), curr.alias("curr_window_count"))
    return with_trend(rows)
