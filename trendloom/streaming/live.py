"""Tickets as they arrive: parse, embed, assign, store, count.

Every micro-batch writes its own folder per table and overwrites it when Spark replays the batch, so a lost driver or
executor adds nothing twice. A ticket and its membership are one row of one write; counts are kept as one small change
row per cluster and batch. The query holds no state: an id is taken once because the ids of the batch meet those that are stored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..functions import text, vectors
from ..functions.ids import webhook_ticket_id
from ..operators import cleaning, models
from ..operators.ranking import first_per_group
from ..operators.similarity import nearest_centroid
from ..operators.trends import trend_label
from ..sources import jobs
from ..sources.json_tickets import parse_tickets
from ..sources.store import UPSERT, TicketStore

CHANGES = "cluster_id string, added bigint"
ARRIVALS = T.StructType(
    schemas.TICKETS.fields + [T.StructField("cluster_id", T.StringType()), T.StructField("similarity_score", T.DoubleType())]
)


def embed_arrivals(parsed: DataFrame, model: models.Model | None = None, **embedding) -> DataFrame:
    """Parsed rows with the vector of good ones; ``error`` also tells of a failed call."""
    body = text.simple_embed_text(F.col("subject"), F.coalesce("description", F.lit("")))
    good = F.when(F.col("error").isNull(), body)
    named = parsed.withColumn("embed_text", good).withColumnRenamed("error", "_parse_error")
    embedded = models.embed_texts(named, "embed_text", model, **embedding)
    return embedded.withColumn("error", F.coalesce("_parse_error", "error")).drop("_parse_error", "embed_text")


def without_stored(parsed: DataFrame, stored: DataFrame) -> DataFrame:
    """The rows whose external id is not among the stored tickets. The ids of the batch are sent to the stored ones where
    Spark finds them small, so that only the column of ids is scanned and nothing of the store is shuffled."""
    named = parsed.withColumn("_ticket_id", webhook_ticket_id(F.col("id")))
    arriving = named.filter(F.col("error").isNull()).select(F.col("_ticket_id").alias("ticket_id")).distinct()
    known = stored.select("ticket_id").join(arriving, "ticket_id", "left_semi").distinct()
    return named.join(known, named["_ticket_id"] == known["ticket_id"], "left_anti").drop("_ticket_id")


def unique_arrivals(embedded: DataFrame) -> DataFrame:
    """Of good rows with one external id the one of the least payload, and every failure once.

    A ticket that failed is not stored, so it may be sent again.
    """
    failure = F.concat(F.lit("failed:"), F.md5(F.concat_ws("|", "error", "payload")))
    key = F.when(F.col("error").isNull(), F.concat(F.lit("id:"), F.col("id"))).otherwise(failure)
    return first_per_group(embedded.withColumn("_key", key), ["_key"], [F.col("payload")]).drop("_key")


def assign_arrivals(good: DataFrame, clusters: DataFrame) -> DataFrame:
    """Embedded rows with nearest cluster, its name and the score."""
    best = nearest_centroid(good, clusters)
    named = clusters.select(F.col("id").alias("cluster_id"), F.col("name").alias("cluster_name"))
    return best.join(named, "cluster_id", "left")


def start_live_ingest(
    spark: SparkSession, payloads: DataFrame, clusters: Callable[[], DataFrame] | DataFrame, root: str, checkpoint: str,
    as_of: Callable[[], Column] = F.current_timestamp, model: models.Model | None = None, trigger: dict | None = None,
    stored: Callable[[], DataFrame] | None = None, **embedding,
) -> StreamingQuery:
    """Starts the query. ``clusters`` may be a function, read anew for every batch; ``stored`` gives further tickets (by
    ``ticket_id``) that are taken, such as those that were folded into the store."""

    def store_batch(batch: DataFrame, batch_id: int) -> None:
        now = as_of()
        table = clusters() if callable(clusters) else clusters
        before = read_live(spark, root, "tickets")
        if "batch_id" in before.columns:  # what a first try of this batch wrote is written again
            before = before.filter(F.col("batch_id") != batch_id)
        known = before.select("ticket_id") if stored is None else before.select("ticket_id").unionByName(stored().select("ticket_id"))
        unique = unique_arrivals(embed_arrivals(without_stored(batch, known), model, **embedding)).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            good, bad = unique.filter(F.col("error").isNull()), unique.filter(F.col("error").isNotNull())
            _write(cleaning.streamed_tickets(assign_arrivals(good, table), now).select(*ARRIVALS.names), root, "arrivals", batch_id)
            _write(jobs.dead_letters(bad, now), root, "job_runs", batch_id)
        finally:
            unique.unpersist()
        written = spark.read.schema(ARRIVALS).parquet(f"{root}/arrivals/batch_id={batch_id}")
        added = written.filter(F.col("cluster_id").isNotNull()).groupBy("cluster_id").agg(F.count("*").alias("added"))
        _write(added.coalesce(1), root, "cluster_changes", batch_id)  # one row per cluster

    writer = parse_tickets(payloads).writeStream.foreachBatch(store_batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "30 seconds"})).start()


def _write(rows: DataFrame, root: str, table: str, batch_id: int) -> None:
    rows.write.mode("overwrite").parquet(f"{root}/{table}/batch_id={batch_id}")


def read_live(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A live table with its ``batch_id``; empty before the first batch. Tickets and members are columns of one table."""
    folder, schema = {
        "tickets": ("arrivals", ARRIVALS), "cluster_members": ("arrivals", ARRIVALS), "job_runs": ("job_runs", schemas.JOB_RUNS),
        "cluster_changes": ("cluster_changes", CHANGES),
    }[table]
    try:
        rows = spark.read.schema(schema).option("basePath", f"{root}/{folder}").parquet(f"{root}/{folder}")
    except AnalysisException:
        rows = spark.createDataFrame([], schema)
    batch = [c for c in rows.columns if c == "batch_id"]
    if table == "tickets":
        return rows.select(*schemas.TICKETS.names, *batch)
    if table == "cluster_members":
        score = vectors.shown_score(F.col("similarity_score")).alias("similarity_score")
        return rows.filter(F.col("cluster_id").isNotNull()).select(F.col("id").alias("ticket_id"), "cluster_id", score, *batch)
    return rows


def fold_into(store: TicketStore, root: str, after_batch: int = -1) -> int:
    """Moves the micro-batches after the given one into the stored tables; returns the last one moved.

    Keys decide, so folding a batch twice changes nothing. Only the folders of the new batches are read.
    """
    live = {t: read_live(store.spark, root, t) for t in ("tickets", "cluster_members", "job_runs")}
    live = {t: rows.filter(F.col("batch_id") > after_batch) for t, rows in live.items() if "batch_id" in rows.columns}
    # A batch may hold dead letters only, so every table is asked.
    ends = [rows.agg(F.max("batch_id")).first()[0] for rows in live.values()]
    last = max((end for end in ends if end is not None), default=after_batch)
    if last <= after_batch:
        return after_batch
    moved = {t: rows.filter(F.col("batch_id") <= last).drop("batch_id") for t, rows in live.items()}
    store.commit(*[(t, UPSERT, store.stage(t, rows)) for t, rows in moved.items()])
    return last


def live_clusters(clusters: DataFrame, changes: DataFrame) -> DataFrame:
    """The clusters with the streamed tickets added to total and current window, and the trend that follows."""
    added = changes.groupBy("cluster_id").agg(F.sum("added").alias("added"))
    joined = clusters.join(added, F.col("id") == F.col("cluster_id"), "left")
    more = F.coalesce(F.col("added"), F.lit(0))
    curr = F.col("curr_window_count") + more
    values = {
        "ticket_count": (F.col("ticket_count") + more).cast("int"),
        "curr_window_count": curr.cast("int"),
        "trend": trend_label(F.col("prev_window_count"), curr),
    }
    return joined.select(*[values[c].alias(c) if c in values else F.col(c) for c in clusters.columns])


def shown_arrivals(tickets: DataFrame, members: DataFrame, clusters: DataFrame) -> DataFrame:
    """What the sender of a ticket gets back: its id, its cluster and the score."""
    own = members.select(F.col("ticket_id").alias("id"), F.col("cluster_id").alias("assigned_cluster_id"), "similarity_score")
    names = clusters.select(F.col("id").alias("assigned_cluster_id"), F.col("name").alias("assigned_cluster"))
    assigned = tickets.select("id", "ticket_id").join(own, "id", "left").join(names, "assigned_cluster_id", "left")
    score = vectors.shown_score(F.col("similarity_score")).alias("similarity_score")
    return assigned.select("ticket_id", F.col("id").alias("db_id"), "assigned_cluster", "assigned_cluster_id", score)
