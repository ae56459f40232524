"""Re-cluster all tickets, or assign new ones to the clusters there are."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from .. import schemas
from ..functions import vectors
from ..operators import clustering, listing, models, trends
from ..operators.similarity import SmallVectors, nearest_centroid, small_vectors
from ..sources.jobs import job_run
from ..sources.store import BASE, TicketStore


def build_clusters(
    tickets: DataFrame, as_of: Column, k: int | None = None, measure: str = "cosine", rule: str = "rolling_closed",
    model: models.Model | None = None, starts: int | None = None, score: str = "cosine", old: SmallVectors | None = None,
    keep: Callable[[DataFrame], DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame] | None:
    """(clusters, members) of all tickets with a usable vector, or None when there are too few.

    With ``old`` centroids, a cluster that continues an old one keeps its id. ``keep`` stores the members and gives
    them back, so that the vectors are assigned once and all else reads three narrow columns; by default they are cached.
    """
    usable = clustering.usable_tickets(tickets)
    if k is None:
        k = clustering.dynamic_k(usable.count())
    if k is None:
        return None
    fitted = clustering.kmeans(usable, k, measure, starts=starts)
    run = uuid.uuid4().hex[:8]  # ids of two runs never meet: a member of an old cluster cannot land in a new one
    fresh = SmallVectors([f"{run}-{i}" for i in fitted.centroids.ids], fitted.centroids.matrix)
    ids = clustering.keep_cluster_ids(fresh, old)
    renamed = F.create_map(*[F.lit(x) for pair in zip(fitted.centroids.ids, ids) for x in pair])
    members = clustering.membership(fitted.rows, "id", score).withColumn("cluster_id", renamed[F.col("cluster_id")])
    members = keep(members) if keep else members.persist(StorageLevel.MEMORY_AND_DISK)
    centroids = tickets.sparkSession.createDataFrame(
        list(zip(ids, fitted.centroids.matrix.tolist())), "cluster_id string, centroid_embedding array<double>"
    )
    return cluster_rows(centroids, members, tickets, as_of, rule, model), members


def cluster_rows(
    centroids: DataFrame, members: DataFrame, tickets: DataFrame, as_of: Column, rule: str, model: models.Model | None
) -> DataFrame:
    """One row per non-empty cluster: name, counts, trend and centroid."""
    if model is None:
        names = models.term_names(listing.member_tickets(members, tickets, "subject"))
    else:
        names = models.name_clusters(listing.top_subjects(members, tickets), model)
    counts = trends.member_windows(members, tickets, as_of=as_of, rule=rule)
    joined = trends.member_totals(members).join(centroids, "cluster_id")
    joined = joined.join(names, "cluster_id", "left").join(counts, "cluster_id", "left")
    prev, curr = (F.coalesce(F.col(c), F.lit(0)) for c in ("prev_window_count", "curr_window_count"))
    return joined.select(
        F.col("cluster_id").alias("id"),
        F.coalesce("name", F.lit(V.FALLBACK_NAME)).alias("name"),
        F.coalesce("description", F.lit(V.FALLBACK_DESCRIPTION)).alias("description"),
        F.col("ticket_count").cast("int").alias("ticket_count"),
        prev.cast("int").alias("prev_window_count"),
        curr.cast("int").alias("curr_window_count"),
        trends.trend_label(prev, curr).alias("trend"),
        "centroid_embedding",
        as_of.alias("updated_at"),
    )


def recluster(store: TicketStore, as_of: Column, keep_ids: bool = False, **options) -> int:
    """Rebuilds clusters and members from the stored tickets; both become current together, at the end."""
    with job_run(store, "recluster") as run:
        replaces = {t: store.visible(t) for t in ("cluster_members", "issue_clusters")}
        tickets = store.read("tickets", "id", "ticket_id", "subject", "priority", "created_at", "embedding")
        old = small_vectors(store.read("issue_clusters"), "id", "centroid_embedding") if keep_ids else None
        staged = []

        def stage_members(members: DataFrame) -> DataFrame:
            staged.append(store.stage("cluster_members", members))
            return store.read_version("cluster_members", staged[0])

        built = build_clusters(tickets, as_of, old=old, keep=stage_members, **options)
        if built is not None:
            clusters, members = built
            version = store.stage("issue_clusters", clusters)
            store.commit(
                ("cluster_members", BASE, staged[0], replaces["cluster_members"]),
                ("issue_clusters", BASE, version, replaces["issue_clusters"]),
            )
            run.tickets_processed = members.count()
        return run.tickets_processed


def assign_new(store: TicketStore, as_of: Column, rule: str = "rolling_closed") -> None:
    """Gives every ticket without a cluster its nearest centroid and refreshes counts and trends."""
    clusters, members = store.read("issue_clusters"), store.read("cluster_members", "ticket_id")
    tickets = store.read("tickets", "id", "embedding")
    fresh = tickets.join(members.select(F.col("ticket_id").alias("id")), "id", "left_anti")
    assigned = nearest_centroid(fresh.filter(vectors.usable(F.col("embedding"))), clusters)
    store.append("cluster_members", clustering.membership(assigned))
    refresh(store, as_of, rule)


def refresh(store: TicketStore, as_of: Column, rule: str = "rolling_closed", stale: str = "zero") -> None:
    replaces = store.visible("issue_clusters")
    tickets = store.read("tickets", "id", "created_at")
    members = store.read("cluster_members", "ticket_id", "cluster_id")
    fresh = trends.refresh_trends(store.read("issue_clusters"), members, tickets, as_of, stale, rule=rule)
    store.replace("issue_clusters", fresh.select(*schemas.CLUSTERS.names), replaces=replaces)
