"""Cluster listings and the ticket examples shown with a cluster.

A cluster may hold a third of all tickets, so a listing of all members is rows in order (a range-partitioned sort splits
a hot cluster between tasks) and not one array per cluster. Arrays are built only of the first n examples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..schemas import EXAMPLE_FIELDS
from .ranking import first_per_group, top_per_group
from .subject_index import SubjectIndex

CLUSTER_FIELDS = (
    "id", "name", "description", "ticket_count", "prev_window_count", "curr_window_count", "trend", "updated_at",
)
LISTED_NAMES = {"id": "ticket_key", "ticket_id": "ticket_id"}
ORDER_FIELDS = ("ticket_id", "created_at")


def example_order(order: str) -> list[Column]:
    """Best match first, or newest first (no date counts as oldest); the ticket id makes it total."""
    if order == "newest":
        return [F.coalesce(F.col("created_at"), F.lit(0).cast("timestamp")).desc(), F.col("ticket_id")]
    return [F.col("similarity_score").desc_nulls_last(), F.col("ticket_id")]


def member_tickets(members: DataFrame, tickets: DataFrame, *fields: str) -> DataFrame:
    """Members with the named fields of their ticket; members without a ticket are left out."""
    wanted = [f for f in (fields or EXAMPLE_FIELDS) if f != "id"]
    side = tickets.select(F.col("id").alias("_id"), *wanted)
    joined = members.select(F.col("ticket_id").alias("_ref"), "cluster_id", "similarity_score").join(
        side, F.col("_ref") == F.col("_id")
    )
    return joined.select("cluster_id", "similarity_score", F.col("_id").alias("id"), *wanted)


def cluster_listing(clusters: DataFrame, members: DataFrame, tickets: DataFrame, order: str = "similarity") -> DataFrame:
    """Every cluster with all its tickets, one row each, largest cluster first; an empty cluster is one row of NULLs.

    The clusters go to the tickets, so a hot cluster is never gathered in one task, and clusters without tickets are
    added at the end.
    """
    examples = member_tickets(members, tickets)
    ticket_columns = [F.col(f).alias(LISTED_NAMES.get(f, f"ticket_{f}")) for f in EXAMPLE_FIELDS]
    keys = [k.alias(f"_k{i}") for i, k in enumerate(_sort_keys(order))]
    side = examples.select("cluster_id", "similarity_score", *ticket_columns, *keys)
    head = clusters.select(*CLUSTER_FIELDS)
    listed = side.join(head, F.col("cluster_id") == F.col("id"))
    empty = head.join(side.select("cluster_id").distinct(), F.col("id") == F.col("cluster_id"), "left_anti")
    rows = listed.drop("cluster_id").unionByName(empty, allowMissingColumns=True)
    return rows.orderBy(F.col("ticket_count").desc(), "id", "_k0", "_k1").drop("_k0", "_k1")


def _sort_keys(order: str) -> list[Column]:
    if order == "newest":
        return [-F.coalesce(F.unix_micros("created_at"), F.lit(0)), F.col("ticket_id")]
    return [-F.col("similarity_score"), F.col("ticket_id")]


def cluster_examples(
    clusters: DataFrame, members: DataFrame, tickets: DataFrame, n: int = 10, order: str = "similarity"
) -> DataFrame:
    """Every cluster with an array of its first ``n`` tickets, best or newest first; empty array if it has none."""
    ranked = top_per_group(member_tickets(members, tickets, *ORDER_FIELDS), ["cluster_id"], example_order(order), n)
    first = with_fields(ranked.select("cluster_id", "id", "rank"), tickets, *EXAMPLE_FIELDS)
    packed = F.transform(
        F.array_sort(F.collect_list(F.struct("rank", F.struct(*EXAMPLE_FIELDS).alias("ticket")))), lambda x: x["ticket"]
    )
    lists = first.groupBy("cluster_id").agg(packed.alias("example_tickets"))
    joined = clusters.select(*CLUSTER_FIELDS).join(lists, F.col("id") == F.col("cluster_id"), "left")
    empty = F.array().cast(lists.schema["example_tickets"].dataType)
    return joined.select(*CLUSTER_FIELDS, F.coalesce("example_tickets", empty).alias("example_tickets")).orderBy(
        F.col("ticket_count").desc(), "id"
    )


def with_fields(chosen: DataFrame, tickets: DataFrame, *fields: str) -> DataFrame:
    """Chosen tickets (by ``id``) with more of their fields.

    Tickets are ranked by narrow columns first. The few that were chosen then go to the tickets, so that texts are
    scanned but never shuffled.
    """
    wanted = [f for f in fields if f not in chosen.columns]
    return tickets.select("id", *wanted).join(chosen, "id")


def search_clusters(
    clusters: DataFrame, members: DataFrame, tickets: DataFrame, text: str = "", trend: str = "all", index: SubjectIndex | None = None
) -> DataFrame:
    """Clusters of a trend whose name, description or any ticket subject contains the text, case ignored. With an index
    of the subjects the tickets are not scanned."""
    found = clusters if trend == "all" else clusters.filter(F.col("trend") == trend)
    if not text:
        return found.select(*CLUSTER_FIELDS)
    q = text.lower()
    if index is not None:
        matching = index.tickets_with(text)
    else:
        matching = tickets.filter(F.lower("subject").contains(q)).select(F.col("id").alias("ticket_id"))
    hits = members.join(matching, "ticket_id", "left_semi").select("cluster_id").distinct()
    by_text = F.lower("name").contains(q) | F.coalesce(F.lower("description").contains(q), F.lit(False))
    joined = found.join(hits, F.col("id") == F.col("cluster_id"), "left")
    return joined.filter(by_text | F.col("cluster_id").isNotNull()).select(*CLUSTER_FIELDS)


def top_subjects(
    members: DataFrame, tickets: DataFrame, n: int = V.NAME_SUBJECTS, order: str = "oldest"
) -> DataFrame:
    """The first ``n`` tickets of each cluster, as a sample for prompts: the oldest to name a cluster, the newest for
    summaries and alerts."""
    keys = [F.col("created_at"), F.col("ticket_id")] if order == "oldest" else example_order(order)
    ranked = top_per_group(member_tickets(members, tickets, *ORDER_FIELDS), ["cluster_id"], keys, n)
    return with_fields(ranked, tickets, "subject", "priority")


def unique_subjects(members: DataFrame, tickets: DataFrame, order: str = "newest") -> DataFrame:
    """Of the tickets of a cluster with one subject only the first."""
    rows = member_tickets(members, tickets, "ticket_id", "subject", "priority", "created_at")
    return first_per_group(rows, ["cluster_id", "subject"], example_order(order))


def card_examples(members: DataFrame, tickets: DataFrame, n: int = V.CARD_SUBJECTS, order: str = "newest") -> DataFrame:
    """The first ``n`` tickets of different subject of each cluster."""
    return top_per_group(unique_subjects(members, tickets, order), ["cluster_id"], example_order(order), n)
