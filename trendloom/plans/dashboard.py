"""The read side: what the application asks of the stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..operators import listing, models, similarity, trends
from ..sources.store import TicketStore


def get_clusters(store: TicketStore, month: str = "all", examples: int = 10) -> DataFrame:
    """The cluster listing with the newest examples, largest cluster first.

    For a month: the clusters with tickets in it, counts and trend against the month before, and examples of the month;
    the order stays that of the whole listing.
    """
    clusters, members, tickets = (store.read(t) for t in ("issue_clusters", "cluster_members", "tickets"))
    if month == "all":
        return listing.cluster_examples(clusters, members, tickets, examples, "newest")
    view = trends.month_view(clusters, members, tickets, month)
    inside = trends.members_in_month(members, tickets, month)
    shown = clusters.select("id", "name", "description", "updated_at", F.col("ticket_count").alias("_all")).join(
        view.select(F.col("cluster_id").alias("id"), "ticket_count", "prev_window_count", "curr_window_count", "trend"), "id"
    )
    listed = listing.cluster_examples(shown, inside, tickets, examples, "newest")
    return listed.join(shown.select("id", "_all"), "id").orderBy(F.col("_all").desc(), "id").drop("_all")


def month_listing(clusters: DataFrame, members: DataFrame, tickets: DataFrame, month: str) -> DataFrame:
    """The clusters with tickets in the month, each with all of these, one row each; counts and trend are the month's."""
    view = trends.month_view(clusters, members, tickets, month)
    counts = ("ticket_count", "prev_window_count", "curr_window_count", "trend")
    shown = clusters.select("id", "name", "description", "updated_at").join(
        view.select(F.col("cluster_id").alias("id"), *counts), "id"
    )
    return listing.cluster_listing(shown, trends.members_in_month(members, tickets, month), tickets, "newest")


def get_clusters_with_tickets(store: TicketStore, month: str = "all") -> DataFrame:
    """Every cluster with all its tickets, or all of the month, one row each."""
    clusters, members, tickets = (store.read(t) for t in ("issue_clusters", "cluster_members", "tickets"))
    if month == "all":
        return listing.cluster_listing(clusters, members, tickets)
    return month_listing(clusters, members, tickets, month)


def find_similar_tickets(
    store: TicketStore, query: list[float], threshold: float = V.SIMILARITY_THRESHOLD, count: int = V.SIMILARITY_LIMIT
) -> DataFrame:
    return similarity.find_similar(store.read("tickets"), query, threshold, count)


def similar_tickets(
    store: TicketStore, text: str, threshold: float = V.SIMILARITY_THRESHOLD, limit: int = V.SIMILARITY_LIMIT,
    model: models.Model | None = None, **embedding,
) -> DataFrame:
    """The tickets most similar to a text, embedded as the stored ones were."""
    if not text.strip():
        raise ValueError("`text` is required")
    threshold, limit = similarity.search_arguments(threshold, limit)
    one = store.spark.createDataFrame([(text.strip(),)], "text string")
    row = models.embed_texts(one, "text", model, **embedding).first()
    if row["error"]:
        raise RuntimeError(f"Embedding failed: {row['error']}")
    return find_similar_tickets(store, list(row["embedding"]), threshold, limit)


def generate_summaries(store: TicketStore, model: models.Model | None = None) -> DataFrame:
    subjects = listing.top_subjects(store.read("cluster_members"), store.read("tickets"), V.SUMMARY_SUBJECTS, "newest")
    return models.summaries(store.read("issue_clusters"), subjects, model)


def draft_alerts(store: TicketStore, model: models.Model | None = None) -> DataFrame:
    subjects = listing.top_subjects(store.read("cluster_members"), store.read("tickets"), V.ALERT_SUBJECTS, "newest")
    return models.alerts(store.read("issue_clusters"), subjects, model)


def tickets_of_source(store: TicketStore, source: str | Column) -> DataFrame:
    return store.read("tickets").filter(F.col("source") == source)
