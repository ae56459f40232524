"""The registered queries: every operator over the given tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import dates, ids, text, trend, vectors
from ..functions.dates import instant
from ..operators import cleaning, clustering, constraints, listing, models, ranking, rollups, sampling, similarity, trends, upsert, vector_index
from ..session import scratch_dir
from ..sources import bindings as B
from ..sources import jobs
from ..sources.bindings import Desk
from ..operators.subject_index import SubjectIndex
from ..sources.csv_tickets import read_ticket_csv
from ..sources.json_tickets import parse_tickets, read_json_stream
from ..sources.store import TICKET_ORDER, TicketStore
from ..streaming import live
from ..streaming import trends as stream_trends
from . import dashboard
from .recluster import recluster as recluster_store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function: Callable[[Desk], DataFrame]) -> Callable[[Desk], DataFrame]:
    QUERIES[function.__name__] = lambda spark, folder: function(Desk(spark, folder))
    return function


def stamp(ts: str | Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def big(*names: str) -> list[Column]:
    return [F.col(n).cast("bigint").alias(n) for n in names]


COUNTS = ("ticket_count", "prev_window_count", "curr_window_count")

# --- trends -------------------------------------------------------------------------------------------------------


def _trends(desk: Desk, rule: str) -> DataFrame:
    return trends.cluster_trends(desk.bare_clusters(), desk.members(), desk.tickets(), as_of=instant(B.AS_OF), rule=rule)


@query
def cluster_trends(desk: Desk) -> DataFrame:
    return _trends(desk, "rolling_closed")


@query
def trends_rolling(desk: Desk) -> DataFrame:
    return _trends(desk, "rolling")


@query
def trends_split(desk: Desk) -> DataFrame:
    return _trends(desk, "split")


def _order_trends(desk: Desk, rule: str) -> DataFrame:
    window = {"as_of": instant(B.ORDERS_AS_OF), "rule": rule}
    return trends.cluster_trends(desk.order_clusters(), desk.order_members(), desk.order_tickets(), **window)


@query
def order_trends_rolling(desk: Desk) -> DataFrame:
    return _order_trends(desk, "rolling")


@query
def order_trends_closed(desk: Desk) -> DataFrame:
    return _order_trends(desk, "rolling_closed")


@query
def order_trends_split(desk: Desk) -> DataFrame:
    return _order_trends(desk, "split")


@query
def event_trends(desk: Desk) -> DataFrame:
    counts = trends.count_windows(desk.table("events"), "event_type", "ts", instant(B.EVENTS_AS_OF), days=10)
    return trends.with_trend(counts)


@query
def event_rolling_trends(desk: Desk) -> DataFrame:
    daily = trends.daily_counts(desk.table("events"), "event_type", "ts")
    return trends.rolling_counts(daily, "event_type", 10).withColumn("day", F.col("day").cast("string"))


@query
def month_view(desk: Desk) -> DataFrame:
    return trends.month_view(desk.bare_clusters(), desk.members(), desk.tickets(), B.MONTH)


@query
def order_month_view(desk: Desk) -> DataFrame:
    view = trends.month_view(desk.order_clusters(), desk.order_members(), desk.order_tickets(), B.ORDERS_MONTH)
    return view.drop("description")


@query
def month_members(desk: Desk) -> DataFrame:
    return trends.members_in_month(desk.members(), desk.tickets(), B.MONTH)


@query
def month_calendar(desk: Desk) -> DataFrame:
    return trends.month_calendar(desk.tickets(), dates.month_start(B.MONTH))


@query
def order_month_calendar(desk: Desk) -> DataFrame:
    return trends.month_calendar(desk.order_tickets(), dates.month_start("2001-10"))


def _stored_clusters(desk: Desk) -> DataFrame:
    """The named clusters with numbers left from an earlier refresh."""
    return desk.bare_clusters().withColumns(
        {"ticket_count": F.lit(5), "prev_window_count": F.lit(4), "curr_window_count": F.lit(1), "trend": F.lit("Decreasing")}
    )


def _refreshed(desk: Desk, stale: str) -> DataFrame:
    rows = trends.refresh_trends(
        _stored_clusters(desk), desk.members(), desk.tickets(), instant(B.AS_OF), stale, rule="rolling"
    )
    return rows.select("id", *big(*COUNTS), "trend", stamp("updated_at").alias("updated_at"))


@query
def refresh_trends(desk: Desk) -> DataFrame:
    return _refreshed(desk, "zero")


@query
def refresh_trends_keep(desk: Desk) -> DataFrame:
    return _refreshed(desk, "keep")


@query
def window_shares(desk: Desk) -> DataFrame:
    rows = trends.with_shares(desk.clusters())
    return rows.select("id", *[F.round(c, 6).alias(c) for c in ("prev_share", "curr_share")])


# --- listings and roll-ups ----------------------------------------------------------------------------------------


def _listed(rows: DataFrame) -> DataFrame:
    kept = ["id", "name", "description", "trend", "ticket_key", "ticket_id", "ticket_subject", "ticket_description", "ticket_priority", "ticket_product_area", "similarity_score"]
    return rows.select(*kept, *big(*COUNTS), *[stamp(c).alias(c) for c in ("updated_at", "ticket_created_at")])


@query
def cluster_listing(desk: Desk) -> DataFrame:
    return _listed(listing.cluster_listing(desk.clusters(), desk.members(), desk.tickets()))


@query
def month_listing(desk: Desk) -> DataFrame:
    """All tickets of a month under their clusters, with the month's counts."""
    return _listed(dashboard.month_listing(desk.clusters(), desk.members(), desk.tickets(), B.MONTH))


def _examples(rows: DataFrame) -> DataFrame:
    shown = F.transform(
        "example_tickets",
        lambda t: F.concat_ws("/", t["ticket_id"], t["priority"], t["product_area"], stamp(t["created_at"]), t["subject"]),
    )
    return rows.select("id", "name", "trend", *big(*COUNTS), F.array_join(shown, "\n").alias("examples"))


@query
def cluster_examples(desk: Desk) -> DataFrame:
    return _examples(listing.cluster_examples(desk.clusters(), desk.members(), desk.tickets(), 10))


@query
def newest_examples(desk: Desk) -> DataFrame:
    return _examples(listing.cluster_examples(desk.clusters(), desk.members(), desk.tickets(), 10, "newest"))


def _found(rows: DataFrame) -> DataFrame:
    return rows.select("id", "name", "trend", *big(*COUNTS))


@query
def cluster_search(desk: Desk) -> DataFrame:
    return _found(listing.search_clusters(desk.clusters(), desk.members(), desk.tickets(), "NTHEND"))


@query
def cluster_search_subject(desk: Desk) -> DataFrame:
    """A word of a few subjects and of no name or description."""
    return _found(listing.search_clusters(desk.clusters(), desk.members(), desk.tickets(), B.SUBJECT_WORD))


@query
def cluster_search_indexed(desk: Desk) -> DataFrame:
    """The same answer by trigram postings of the subjects."""
    index = SubjectIndex.build(desk.tickets(), scratch_dir(desk.spark, "subjects"))
    return _found(listing.search_clusters(desk.clusters(), desk.members(), desk.tickets(), B.SUBJECT_WORD, index=index))


@query
def cluster_search_trend(desk: Desk) -> DataFrame:
    return _found(listing.search_clusters(desk.clusters(), desk.members(), desk.tickets(), "fail", "Increasing"))


@query
def kpis(desk: Desk) -> DataFrame:
    return rollups.kpis(desk.clusters())


@query
def segment_rollup(desk: Desk) -> DataFrame:
    return rollups.segment_trends(desk.clusters())


@query
def segment_share(desk: Desk) -> DataFrame:
    return rollups.segment_shares(desk.clusters())


@query
def subject_segments(desk: Desk) -> DataFrame:
    """Segment and theme rules over every ticket text."""
    return desk.tickets_by(segment=text.segment, theme=text.theme).withColumn("key", text.slug(F.col("segment")))


@query
def top_subjects(desk: Desk) -> DataFrame:
    return listing.top_subjects(desk.members(), desk.tickets()).select("cluster_id", "ticket_id", "subject", big("rank")[0])


@query
def unique_subjects(desk: Desk) -> DataFrame:
    return listing.unique_subjects(desk.members(), desk.tickets()).select("cluster_id", "subject", "ticket_id")


@query
def distinct_examples(desk: Desk) -> DataFrame:
    return listing.card_examples(desk.members(), desk.tickets()).select("cluster_id", "subject", "ticket_id", big("rank")[0])


@query
def tickets_by_source(desk: Desk) -> DataFrame:
    found = desk.tickets().filter(F.col("source") == "src7")
    return found.select("ticket_id", "source", "subject")


@query
def ticket_ages(desk: Desk) -> DataFrame:
    age = dates.age_text(F.col("ts"), instant(B.EVENTS_AS_OF))
    return desk.table("events").select("event_id", age.alias("age"))


@query
def change_numbers(desk: Desk) -> DataFrame:
    """Percent texts, alert percent and projection for the orders of each customer by status."""
    counts = desk.table("orders").groupBy("o_custkey").agg(
        F.count_if(F.col("o_orderstatus") == "F").alias("prev"), F.count_if(F.col("o_orderstatus") == "O").alias("curr")
    )
    prev, curr = F.col("prev"), F.col("curr")
    return counts.select(
        "o_custkey", "prev", "curr", trend.trend_label(prev, curr).alias("trend"), trend.percent_text(prev, curr).alias("pct_text"),
        trend.alert_percent(prev, curr).cast("bigint").alias("alert_pct"), trend.projection(curr).alias("projected"),
    )


# --- cleaning -----------------------------------------------------------------------------------------------------


def raw_rows(desk: Desk) -> DataFrame:
    """Documents as raw CSV rows: some without subject, some without description, mixed priorities and dates."""
    d = desk.table("documents").alias("d").join(desk.table("events").alias("e"), F.col("doc_id") == F.col("event_id"), "left")
    head = F.concat_ws(" ", F.lit("About"), F.col("source"), F.col("lang"), F.col("n_chars").cast("string"))
    return d.select(
        F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 11 == 1, "  ").otherwise(F.concat(F.lit(" "), head, F.lit(" "))).alias("subject"),
        F.when(F.col("doc_id") % 4 == 1, "").when(F.col("doc_id") % 11 == 1, " ").otherwise(F.col("text")).alias("description"),
        _date_text(F.col("doc_id"), F.col("ts")).alias("date"),
        F.coalesce(B._mapped(B.PRIORITY_OF_EVENT, F.col("event_type")), F.col("event_type")).alias("priority"),
        F.when(F.col("lang") == "en", "").otherwise(F.col("lang")).alias("ticket_type"),
        F.when(F.col("source") == "src0", None).otherwise(F.col("source")).alias("product_area"),
        F.when(F.col("doc_id") % 5 == 0, F.col("doc_id").cast("string")).otherwise("").alias("raw_ticket_id"),
        F.when(F.col("lang") == "fr", "Closed").when(F.col("lang") == "de", "Pending Customer Response").otherwise(F.col("lang")).alias("status"),
        F.col("doc_id").alias("seq"),
    )


def _date_text(key: Column, ts: Column) -> Column:
    return (
        F.when(key % 7 == 0, "junk").when(key % 7 == 1, "").when(key % 7 == 2, "2024-02-30").when(key % 7 == 3, F.date_format(ts, "yyyy-MM-dd"))
        .when(key % 7 == 4, F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
        .when(key % 7 == 5, F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+05:30")))
        .otherwise(F.concat(F.lit(" "), F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit(" ")))
    )


CLEAN = ("ticket_id", "subject", "description", "priority", "ticket_type", "product_area", "status", "source")


@query
def clean_tickets(desk: Desk) -> DataFrame:
    rows = cleaning.clean_tickets(cleaning.with_text(raw_rows(desk)), instant(B.AS_OF))
    return rows.select("seq", *CLEAN, stamp("created_at").alias("created_at"), "dated")


@query
def clean_tickets_month(desk: Desk) -> DataFrame:
    rows = cleaning.clean_tickets(cleaning.with_text(raw_rows(desk)), instant(B.AS_OF), B.MONTH)
    return rows.select("seq", "ticket_id", stamp("created_at").alias("created_at"))


@query
def rejected_rows(desk: Desk) -> DataFrame:
    both = cleaning.rejected(raw_rows(desk)).select("seq", F.lit("either").alias("rule"))
    return both.unionByName(cleaning.rejected(raw_rows(desk), "subject").select("seq", F.lit("subject").alias("rule")))


@query
def stable_ids(desk: Desk) -> DataFrame:
    subject, body = text.subject_from(F.col("text")), F.col("text")
    raw = F.when(F.col("doc_id") % 5 == 0, F.col("doc_id").cast("string"))
    return desk.table("documents").select(
        "doc_id",
        ids.stable_ticket_id(subject, body).alias("by_text"),
        ids.stable_ticket_id(subject, body, raw).alias("by_raw"),
        ids.stable_ticket_id(subject, body, raw, B.MONTH).alias("by_month"),
    )


@query
def origin_ids(desk: Desk) -> DataFrame:
    key = F.col("o_orderkey")
    webhook, padded = ids.webhook_ticket_id(key.cast("string")), ids.padded_ticket_id(key)
    return desk.table("orders").select(
        "o_orderkey", webhook.alias("webhook_id"), padded.alias("padded_id"),
        ids.upload_ticket_id(1700000000000, key).alias("upload_id"), ids.numbered_ticket_id(key, "KR-").alias("numbered_id"),
    )


@query
def sequential_ids(desk: Desk) -> DataFrame:
    incoming = desk.table("orders").select("o_orderkey")
    return cleaning.next_numbered_ids(desk.tickets().select("ticket_id"), incoming, "o_orderkey")


@query
def month_coerce(desk: Desk) -> DataFrame:
    rows = desk.table("events").select("event_id", _date_text(F.col("event_id"), F.col("ts")).alias("date"))
    coerced = dates.coerce_to_month(F.col("date"), B.MONTH)
    return rows.select("event_id", coerced.alias("kept"), dates.coerce_to_month(F.col("date"), "2023-12").alias("moved"))


@query
def parsed_dates(desk: Desk) -> DataFrame:
    rows = desk.table("events").select("event_id", _date_text(F.col("event_id"), F.col("ts")).alias("date"))
    return rows.select("event_id", stamp(dates.created_at(F.trim("date"), instant(B.AS_OF))).alias("created_at"))


@query
def embed_text(desk: Desk) -> DataFrame:
    parts = [F.col(c) for c in ("subject", "description", "ticket_type", "product_area")]
    return desk.tickets().select(
        "ticket_id", F.md5(text.rich_embed_text(*parts)).alias("rich"),
        F.md5(text.simple_embed_text(parts[0], parts[1])).alias("simple"),
        F.md5(text.simple_embed_text(parts[0], parts[1], ": ")).alias("colon"),
    )


@query
def template_texts(desk: Desk) -> DataFrame:
    """Template texts are found, and left out of the text to embed."""
    subject, props = F.col("event_type"), F.col("props")
    rich = text.rich_embed_text(subject, props, F.lit("Support Request"), F.col("user_id").cast("string"))
    return desk.table("events").select("event_id", text.is_template(props).alias("is_template"), rich.alias("rich"))


@query
def placeholder_fill(desk: Desk) -> DataFrame:
    body = F.concat(F.lit("Issue with the {product_purchased}. The {product_purchased} is "), F.col("p_type"))
    return desk.table("part").select("p_partkey", text.fill_placeholder(body, F.col("p_name")).alias("description"))


@query
def status_map(desk: Desk) -> DataFrame:
    given = F.when(F.col("o_orderstatus") == "F", "Closed").when(F.col("o_orderstatus") == "O", "Open").when(
        F.col("o_orderpriority") == "2-HIGH", "Pending Customer Response").otherwise(F.col("o_orderstatus"))
    return desk.table("orders").groupBy(given.alias("given"), text.mapped_status(given).alias("status")).agg(F.count("*").alias("n"))


@query
def priority_rule(desk: Desk) -> DataFrame:
    tickets = desk.tickets()
    valid = text.valid_priority(F.col("priority"))
    return tickets.groupBy(F.col("priority").alias("given"), valid.alias("priority")).agg(F.count("*").alias("tickets"))


@query
def dedupe_last(desk: Desk) -> DataFrame:
    """Tickets of one text are one ticket; the last stays."""
    rows = desk.table("documents").select(
        ids.stable_ticket_id(text.subject_from(F.col("text")), F.col("text")).alias("ticket_id"), F.col("doc_id").alias("seq"), "lang"
    )
    return ranking.last_per_id(rows)


@query
def dedupe_hot(desk: Desk) -> DataFrame:
    """Many rows of few ids: the last event of every kind."""
    rows = desk.table("events").select(F.col("event_type").alias("ticket_id"), F.struct("ts", "event_id").alias("seq"), "event_id", "value")
    return ranking.last_per_id(rows).drop("seq")


@query
def stratified_sample(desk: Desk) -> DataFrame:
    return sampling.stratified_sample(desk.table("documents").select("doc_id", "source"), "source", "doc_id", 150)


@query
def stratified_sample_large(desk: Desk) -> DataFrame:
    """More rows per stratum than a rank filter takes."""
    return sampling.stratified_sample(desk.table("orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "o_orderkey", 6000)


# --- upserts, constraints, jobs -----------------------------------------------------------------------------------


def _incoming(desk: Desk) -> DataFrame:
    """A later batch for the text desk: texts of the benchmark and conversations under new and known ids."""
    c = desk.table("conversations").select((F.col("conv_id") * 3).alias("k"), F.col("turn").alias("seq"), "text", "role")
    ticket_id = F.concat(F.lit("TKT-"), F.col("k").cast("string"))
    return c.select(
        ids.row_id(ticket_id).alias("id"), ticket_id.alias("ticket_id"), text.subject_from(F.col("text")).alias("subject"),
        F.col("text").alias("description"), F.lit("High").alias("priority"), F.lit("Chat").alias("ticket_type"),
        F.col("role").alias("product_area"), F.lit("Open").alias("status"), F.lit("support").alias("source"),
        F.lit(None).cast("array<float>").alias("embedding"), instant("2024-02-01").alias("created_at"),
        (F.col("k") % 2 == 0).alias("dated"), "seq",
    )


@query
def upsert_tickets(desk: Desk) -> DataFrame:
    merged = upsert.upsert_tickets(desk.tickets(), _incoming(desk))
    return merged.select("id", "ticket_id", "subject", "priority", "product_area", "source", stamp("created_at").alias("created_at"))


@query
def upsert_members(desk: Desk) -> DataFrame:
    moved = desk.vectors().select(
        ids.row_id(F.concat(F.lit("TKT-"), F.col("vec_id").cast("string"))).alias("ticket_id"),
        F.when(F.col("vec_id") % 2 == 0, F.col("cluster_id")).otherwise("C10").alias("cluster_id"), F.lit(0.5).alias("similarity_score"),
    )
    return upsert.upsert_members(desk.members(), moved)


@query
def cascade_delete(desk: Desk) -> DataFrame:
    """Members left when the tickets without priority rule and one cluster are gone."""
    tickets = desk.tickets().filter(F.col("priority").isin(*V.PRIORITIES))
    return upsert.cascade(desk.members(), tickets, desk.bare_clusters().filter(F.col("id") != "C03"))


@query
def constraint_report(desk: Desk) -> DataFrame:
    vectors_as_tickets = desk.table("embeddings").select(F.md5(F.concat(F.lit("TKT-"), F.col("vec_id").cast("string"))).alias("id"))
    report = constraints.constraint_report(
        {"tickets": desk.tickets(), "issue_clusters": desk.bare_clusters().withColumn("centroid_embedding", F.array(F.lit(0.0)).cast("array<double>")), "cluster_members": desk.members()},
        B.VECTOR_DIM,
    )
    lost = constraints.orphans(desk.members(), "ticket_id", vectors_as_tickets).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("violations"))
    return report.unionByName(lost.select(F.lit("cluster_members").alias("table"), F.lit("vector missing").alias("rule"), "violations"))


@query
def duplicate_keys(desk: Desk) -> DataFrame:
    """Texts that occur more than once, and how often."""
    rows = desk.table("documents").select(F.md5("text").alias("text_md5"))
    return constraints.duplicate_keys(rows, "text_md5")


@query
def orphan_members(desk: Desk) -> DataFrame:
    """Line items as members of orders by part: parts without an order of the same number."""
    members = desk.table("lineitem").select(F.col("l_partkey").alias("ticket_id"))
    parents = desk.table("customer").select(F.col("c_custkey").alias("id"))
    return constraints.orphans(members, "ticket_id", parents)


def job_log(desk: Desk) -> DataFrame:
    """Events as an audit log: every run starts, and most end."""
    kind = F.element_at(F.array(*[F.lit(t) for t in V.JOB_TYPES]), (F.col("user_id") % len(V.JOB_TYPES) + 1).cast("int"))
    start = desk.table("events").select(
        F.col("event_id").cast("string").alias("id"), kind.alias("job_type"), F.lit("running").alias("status"),
        F.lit(0).alias("tickets_processed"), F.lit(None).cast("string").alias("error_message"), F.col("ts").alias("started_at"),
        F.lit(None).cast("timestamp").alias("finished_at"), "event_type", "value", "props",
    )
    failed = F.col("event_type") == "error"
    end = start.filter(F.col("event_type") != "view").withColumns(
        {
            "status": F.when(failed, "failed").otherwise("success"),
            "tickets_processed": F.when(failed, 0).otherwise(F.floor("value").cast("int")),
            "error_message": F.when(failed, jobs.dead_letter_message(F.lit("error"), F.col("props"))),
            "finished_at": F.col("started_at") + F.expr("interval 5 seconds"),
        }
    )
    return start.unionByName(end)


@query
def current_jobs(desk: Desk) -> DataFrame:
    runs = jobs.current_runs(job_log(desk))
    return runs.select("id", "job_type", "status", "error_message", big("tickets_processed")[0])


@query
def latest_jobs(desk: Desk) -> DataFrame:
    runs = jobs.latest_jobs(job_log(desk))
    return runs.select("id", "job_type", "status", "error_message", big("tickets_processed")[0], stamp("started_at").alias("started_at"))


# --- vectors and clusters -----------------------------------------------------------------------------------------


@query
def cluster_centroids(desk: Desk) -> DataFrame:
    means = clustering.cluster_centroids(desk.vectors())
    position = F.posexplode("centroid").alias("position", "value")
    flat = means.select("cluster_id", "members", position)
    return flat.select("cluster_id", "members", F.col("position").cast("bigint").alias("position"), F.round("value", 6).alias("value"))


def _centroid_table(desk: Desk) -> DataFrame:
    return clustering.cluster_centroids(desk.vectors()).select(F.col("cluster_id").alias("id"), F.col("centroid").alias("centroid_embedding"))


@query
def nearest_centroid(desk: Desk) -> DataFrame:
    best = similarity.nearest_centroid(desk.table("embeddings"), _centroid_table(desk), "vec_id")
    return best.select("vec_id", "cluster_id", vectors.shown_score(F.col("similarity_score")).alias("similarity_score"))


@query
def nearest_centroid_blocks(desk: Desk) -> DataFrame:
    """The same answer by the plan for centroid tables over the size bound."""
    best = vector_index.pruned_topk(_centroid_table(desk), desk.table("embeddings"), 1, None, "id", "centroid_embedding", "vec_id", "embedding")
    return best.select(F.col("query_id").alias("vec_id"), F.col("match_id").alias("cluster_id"), F.round("similarity", 6).alias("similarity_score"))


@query
def member_scores(desk: Desk) -> DataFrame:
    """Cosine of every ticket to the centroid of its own cluster."""
    own = similarity.member_scores(desk.vectors(), _centroid_table(desk))
    return own.select("vec_id", vectors.shown_score(F.col("similarity_score")).alias("similarity_score"))


@query
def unit_vectors(desk: Desk) -> DataFrame:
    rows = desk.table("embeddings").select("vec_id", vectors.normalised(F.col("embedding")).alias("u"))
    return rows.select("vec_id", F.round(vectors.norm(F.col("u")), 6).alias("length"), F.round(F.get("u", 0), 6).alias("first"), F.round(F.get("u", 63), 6).alias("last"))


@query
def parsed_vectors(desk: Desk) -> DataFrame:
    """Vectors that arrive as JSON text; some are damaged."""
    sent = F.to_json(vectors.as_doubles(F.col("embedding")))
    sent = F.when(F.col("vec_id") % 9 == 0, F.concat(F.lit("oops"), sent)).otherwise(sent)
    rows = desk.table("embeddings").select("vec_id", vectors.parse_vector(sent).alias("v"))
    kept = rows.select("vec_id", vectors.usable(F.col("v"), B.VECTOR_DIM).alias("usable"), F.round(F.get("v", 3), 6).alias("third"))
    return kept


@query
def similar_topk(desk: Desk) -> DataFrame:
    """The ten tickets nearest to the centroid of every cluster."""
    queries = _centroid_table(desk).select(F.col("id").alias("query_id"), F.col("centroid_embedding").alias("embedding"))
    best = similarity.similar_topk(desk.table("embeddings"), queries, 10, 0.2, "vec_id")
    return best.select("query_id", "match_id", F.round("similarity", 6).alias("similarity"), big("rank")[0])


@query
def similar_topk_blocks(desk: Desk) -> DataFrame:
    """For every vector its three nearest, by the plan for two large sides."""
    rows = desk.table("embeddings")
    best = vector_index.pruned_topk(rows, rows, 3, None, "vec_id", "embedding", "vec_id", "embedding")
    return best.select("query_id", "match_id", F.round("similarity", 6).alias("similarity"), big("rank")[0])


@query
def find_similar(desk: Desk) -> DataFrame:
    """The search function for one vector: the mean of all."""
    center = clustering.cluster_centroids(desk.vectors().withColumn("cluster_id", F.lit("all"))).first()["centroid"]
    best = similarity.find_similar(desk.tickets(), list(center), 0.1, 10)
    return best.select("id", "ticket_id", "subject", "priority", stamp("created_at").alias("created_at"), F.round("similarity", 6).alias("similarity"))


@query
def similar_approximate(desk: Desk) -> DataFrame:
    center = clustering.cluster_centroids(desk.vectors().withColumn("cluster_id", F.lit("all"))).first()["centroid"]
    index = vector_index.VectorIndex.build(desk.tickets(), scratch_dir(desk.spark, "index"))
    return index.search(list(center), 0.1, 10)


@query
def similar_indexed(desk: Desk) -> DataFrame:
    """``find_similar`` by the stored index, exactly: cells that cannot hold a match are not read."""
    center = clustering.cluster_centroids(desk.vectors().withColumn("cluster_id", F.lit("all"))).first()["centroid"]
    index = vector_index.VectorIndex.build(desk.tickets(), scratch_dir(desk.spark, "index"))
    best = vector_index.find_similar_indexed(desk.tickets(), index, list(center), threshold=0.1, limit=10, exact=True)
    return best.select("id", "ticket_id", "subject", "priority", stamp("created_at").alias("created_at"), F.round("similarity", 6).alias("similarity"))


@query
def lloyd_3(desk: Desk) -> DataFrame:
    """Three rounds from the centroids of the labels."""
    start = similarity.small_vectors(_centroid_table(desk), "id", "centroid_embedding")
    found = clustering.lloyd(desk.table("embeddings"), start, 3)
    return found.rows.select("vec_id", "cluster_id", F.round("similarity_score", 6).alias("similarity_score"))


@query
def kmeans_starts(desk: Desk) -> DataFrame:
    """Three rounds from two starts in the same scans: the means of the labels, and of the ids by their last digit."""
    rows = desk.table("embeddings").withColumn("unit", vectors.normalised(F.col("embedding")))
    seeds = []
    for group in (F.col("label"), F.col("vec_id") % 10):
        means = clustering.cluster_centroids(rows.withColumn("g", group.cast("int")), "g", "unit").orderBy("g").collect()  # ten rows
        seeds.append([r["centroid"] for r in means])
    found = clustering.lloyd_starts(rows, np.array(seeds), 3, tolerance=0.0)
    table = [
        (s, c, int(found.members[s, c]), round(float(found.costs[s, c]), 6)) for s in range(2) for c in range(found.members.shape[1]) if found.members[s, c]
    ]
    return desk.spark.createDataFrame(table, "start int, cluster int, members bigint, cost double")


def _kmeans(desk: Desk, measure: str) -> DataFrame:
    rows = clustering.usable_tickets(desk.table("embeddings"))
    found = clustering.kmeans(rows, clustering.dynamic_k(rows.count()), measure)
    return clustering.membership(found.rows, "vec_id")


@query
def kmeans_euclidean(desk: Desk) -> DataFrame:
    return _kmeans(desk, "euclidean")


@query
def kmeans_cosine(desk: Desk) -> DataFrame:
    return _kmeans(desk, "cosine")


def _reclustered(desk: Desk) -> TicketStore:
    """The whole job on stored tickets."""
    store = TicketStore(desk.spark, scratch_dir(desk.spark, "store"))
    store.replace("tickets", desk.tickets())
    recluster_store(store, instant(B.AS_OF))
    return store


@query
def recluster(desk: Desk) -> DataFrame:
    return _reclustered(desk).read("issue_clusters").drop("updated_at")


@query
def recluster_totals(desk: Desk) -> DataFrame:
    """Whatever the clusters are, their counts add up to the tickets with a vector."""
    store = _reclustered(desk)
    sums = [F.sum(c).cast("bigint").alias(c) for c in COUNTS]
    rows = store.read("issue_clusters").agg(*sums, (F.count("*") <= V.CLUSTER_MAX).alias("bounded"))
    members = store.read("cluster_members")
    distinct = members.agg(F.count_distinct("ticket_id"))
    lowest = members.agg(F.min("similarity_score") > 0)
    return rows.withColumns({"members": distinct.scalar(), "positive": lowest.scalar()})


@query
def text_vectors(desk: Desk) -> DataFrame:
    """Every ticket text embedded by the offline default."""
    return models.embed_texts(_texts(desk), "embed_text").select("ticket_id", "embedding")


@query
def text_vectors_weighted(desk: Desk) -> DataFrame:
    return models.embed_texts_weighted(_texts(desk), "embed_text", 256).select("ticket_id", "embedding")


@query
def text_vector_lengths(desk: Desk) -> DataFrame:
    """Texts with a word have unit vectors."""
    rows = models.embed_texts(_texts(desk), "embed_text")
    length = F.round(vectors.norm(vectors.as_doubles(F.col("embedding"))), 4)
    return rows.select("ticket_id", F.size("embedding").cast("bigint").alias("dim"), length.alias("length"))


def _texts(desk: Desk) -> DataFrame:
    body = text.simple_embed_text(F.col("subject"), F.col("description"))
    return desk.tickets().select("ticket_id", body.alias("embed_text"))


@query
def model_batches(desk: Desk) -> DataFrame:
    """A pluggable model over whole texts in batches: here a model that measures length."""
    rows = desk.table("documents").select("doc_id", "text")
    measured = models.apply_model(rows, "text", lambda texts: [float(len(t)) for t in texts], "length", "double")
    return measured.select("doc_id", F.col("length").cast("bigint").alias("length"), "error")


# --- names, summaries, alerts -------------------------------------------------------------------------------------


@query
def prompt_rows(desk: Desk) -> DataFrame:
    return models.name_prompts(listing.top_subjects(desk.members(), desk.tickets()))


@query
def term_names(desk: Desk) -> DataFrame:
    return models.term_names(listing.member_tickets(desk.members(), desk.tickets(), "subject"))


@query
def theme_summary(desk: Desk) -> DataFrame:
    subjects = listing.top_subjects(desk.members(), desk.tickets(), V.SUMMARY_SUBJECTS, "newest")
    return models.summaries(desk.clusters(), subjects)


@query
def alert_rows(desk: Desk) -> DataFrame:
    rows = models.alerts(desk.clusters(), listing.top_subjects(desk.members(), desk.tickets(), V.ALERT_SUBJECTS, "newest"))
    return rows.select("cluster_id", "name", *big("prev", "curr", "pct", "projected"), "prompt", "email", "mock")


# --- files, store and streams -------------------------------------------------------------------------------------


@query
def csv_ingest(desk: Desk) -> DataFrame:
    """Documents written as CSV under other header names, read back, cleaned and deduplicated."""
    path = scratch_dir(desk.spark, "csv")
    d = desk.table("documents").select(
        F.concat(F.lit("S "), F.col("doc_id").cast("string")).alias("Ticket Subject"), F.regexp_replace("text", "\r", " ").alias(" TICKET Description"),
        F.col("lang").alias("ticket type"), F.col("source").alias("Product Purchased"), F.lit("x").alias("unknown"),
        F.col("doc_id").cast("string").alias("Ticket ID"),
    )
    d.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    rows = ranking.last_per_id(cleaning.clean_tickets(cleaning.with_text(read_ticket_csv(desk.spark, path)), instant(B.AS_OF)))
    return rows.select("ticket_id", "subject", F.md5("description").alias("description_md5"), "ticket_type", "product_area", "priority")


@query
def csv_lines(desk: Desk) -> DataFrame:
    """Orders through the line dialect."""
    path = scratch_dir(desk.spark, "csv")
    o = desk.table("orders").select(
        F.col("o_orderpriority").alias("subject"), F.concat_ws(" ", "o_orderstatus", F.lit('says "hi", twice')).alias("description"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date of purchase"), F.col("o_orderkey").cast("string").alias("ticket_id"),
    )
    o.write.option("header", True).option("escape", '"').csv(path)
    rows = cleaning.clean_tickets(read_ticket_csv(desk.spark, path, multiline=False, require=("subject",)), instant(B.AS_OF))
    return rows.select("ticket_id", "subject", "description", stamp("created_at").alias("created_at"))


def json_payloads(desk: Desk) -> DataFrame:
    """Every turn of the conversations as a JSON ticket: some damaged, some without subject, some repeated."""
    number = F.col("conv_id") * 100 + F.col("turn")
    fields = F.struct(
        F.when(F.col("role") == "system", F.lit("SYS")).otherwise(number.cast("string")).alias("id"),
        F.when(F.col("turn") % 5 == 4, "").otherwise(text.subject_from(F.regexp_replace("text", "\\s+", " "))).alias("subject"),
        F.col("text").alias("description"), F.col("role").alias("product_area"),
    )
    body = F.to_json(fields)
    payload = F.when((F.col("turn") % 3 == 2) & (F.col("conv_id") % 4 == 0), F.concat(F.lit("{oops "), body)).otherwise(body)
    return desk.table("conversations").select("conv_id", "turn", payload.alias("payload"))


@query
def json_tickets(desk: Desk) -> DataFrame:
    parsed = parse_tickets(json_payloads(desk))
    return parsed.select("conv_id", "turn", "id", "subject", F.md5("description").alias("description_md5"), "product_area", "error")


@query
def dead_letters(desk: Desk) -> DataFrame:
    bad = parse_tickets(json_payloads(desk)).filter(F.col("error").isNotNull())
    return jobs.dead_letters(bad, instant(B.AS_OF)).select("id", "job_type", "status", "error_message")


@query
def store_versions(desk: Desk) -> DataFrame:
    """Tickets stored, replaced and appended to; the reader sees the last whole version."""
    store = TicketStore(desk.spark, scratch_dir(desk.spark, "store"))
    store.clear("tickets")
    store.replace("tickets", desk.tickets(), TICKET_ORDER)
    store.append("tickets", _incoming(desk))
    rows = store.read("tickets", "ticket_id", "subject", "source", "created_at")
    return rows.select("ticket_id", "subject", "source", stamp("created_at").alias("created_at"))


@query
def stream_ingest(desk: Desk) -> DataFrame:
    """The JSON tickets as a stream of files through parsing, embedding, assignment and the stored tables."""
    spark, root = desk.spark, scratch_dir(desk.spark, "live")
    json_payloads(desk).select("payload").repartition(8, "payload").write.text(f"{root}/in")
    dim = 64
    base = models.embed_texts(desk.tickets().select(F.col("id").alias("ticket_id"), "description"), "description", dim=dim)
    labelled = base.join(desk.members().select("ticket_id", "cluster_id"), "ticket_id")
    centroids = clustering.cluster_centroids(labelled).select(F.col("cluster_id").alias("id"), F.col("centroid").alias("centroid_embedding"))
    store = TicketStore(spark, f"{root}/store")
    store.replace("issue_clusters", desk.bare_clusters().join(centroids, "id"))
    running = live.start_live_ingest(
        spark, read_json_stream(spark, f"{root}/in", 4), lambda: store.read("issue_clusters"), f"{root}/out", f"{root}/checkpoint",
        as_of=lambda: instant(B.AS_OF), trigger={"availableNow": True}, dim=dim,
    )
    running.awaitTermination()
    tickets = live.read_live(spark, f"{root}/out", "tickets").select(F.col("id").alias("ticket_ref"), "ticket_id", "priority", "status", "source")
    members = live.read_live(spark, f"{root}/out", "cluster_members").select(F.col("ticket_id").alias("ticket_ref"), "similarity_score")
    joined = tickets.join(members, "ticket_ref")
    return joined.select("ticket_id", "priority", "status", "source", (F.col("similarity_score") <= 1.000001).alias("scored"))


def _event_stream(desk: Desk) -> DataFrame:
    reader = desk.spark.readStream.schema(B.LAYOUTS["events"]).option("pathGlobFilter", "events.parquet")
    return reader.parquet(desk.folder)


@query
def stream_daily_trends(desk: Desk) -> DataFrame:
    """Rolling ten-day trends of the event stream from its daily counters."""
    spark, root = desk.spark, scratch_dir(desk.spark, "daily")
    daily = stream_trends.daily_stream(_event_stream(desk), "event_type", "ts")
    stream_trends.start_daily_counts(daily, f"{root}/daily", f"{root}/checkpoint", {"availableNow": True}).awaitTermination()
    stored = spark.read.option("basePath", f"{root}/daily").parquet(f"{root}/daily")
    return stream_trends.stream_trends(stored, "event_type", 10).withColumn("day", F.col("day").cast("string"))


@query
def stream_windows(desk: Desk) -> DataFrame:
    """Sliding ten-day windows from the stream itself."""
    spark, root = desk.spark, scratch_dir(desk.spark, "windows")
    counts = stream_trends.window_stream(_event_stream(desk), "event_type", "ts", 10)
    stream_trends.start_daily_counts(counts, f"{root}/windows", f"{root}/checkpoint", {"availableNow": True}).awaitTermination()
    stored = spark.read.option("basePath", f"{root}/windows").parquet(f"{root}/windows")
    last = stored.groupBy("event_type", "window_start", "window_end").agg(F.max_by("tickets", "batch_id").alias("tickets"))
    return last.select("event_type", stamp("window_start").alias("window_start"), stamp("window_end").alias("window_end"), "tickets")
