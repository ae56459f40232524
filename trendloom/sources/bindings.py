"""The given Parquet tables read as tickets, clusters, members and so on.

Two support desks are made from them:

* documents + embeddings (+ events for the priority): tickets with text and vectors, ten clusters by label and one empty;
* orders + customer + nation: a larger desk without text, one cluster per nation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.dates import instant
from ..functions.ids import row_id
from ..operators.trends import refresh_trends

AS_OF = "2024-01-31T00:00:00+00:00"
MONTH = "2024-01"
SUBJECT_WORD = "heitver"  # in some subjects, in no name or description
ORDERS_AS_OF = "1998-01-31T00:00:00+00:00"
ORDERS_MONTH = "1996-01"
EVENTS_AS_OF = "2024-01-25T00:00:00+00:00"
VECTOR_DIM = 64

# Known layouts, so that no file has to be opened to plan a query. Times are UTC.
LAYOUTS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp, "
    "o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "events": "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
}

# Cluster id, name, description of the text desk.
CLUSTER_NAMES = (
    ("C00", "Bluetooth Pairing Failure", "Devices do not pair."),
    ("C01", "Webcam Hardware Defects", "The picture is distorted."),
    ("C02", "Firmware Update Errors", "Updates stop half way."),
    ("C03", "Missing Package Delivery", "Parcels do not arrive."),
    ("C04", "Refund And Exchange Requests", "Money or goods back."),
    ("C05", "Login Password Problems", "Accounts are locked."),
    ("C06", "Slow Dashboard Performance", "Pages take long."),
    ("C07", "Setup Wizard Stalls", "First use fails."),
    ("C08", "App Crash On Export", "The program ends."),
    ("C09", "General Issues", "Miscellaneous support tickets."),
    ("C10", "Billing Invoice Questions", "Nobody has asked yet."),
)
PRIORITY_OF_EVENT = {"error": "Critical", "purchase": "High", "signup": "Medium", "click": "Low"}
TYPE_OF_LANG = {"en": "Support Request", "fr": "Technical Issue", "de": "Bug Report"}


class Desk:
    """The bound tables of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.folder = spark, folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(LAYOUTS[name]).parquet(f"{self.folder}/{name}.parquet")

    # --- the text desk ---

    def _keyed(self) -> DataFrame:
        """One row per document or vector."""
        documents = self.table("documents").select("doc_id", "text", "lang", "source")
        joined = documents.join(self.table("embeddings"), F.col("doc_id") == F.col("vec_id"), "full")
        return joined.withColumn("k", F.coalesce("doc_id", "vec_id"))

    def tickets(self) -> DataFrame:
        events = self.table("events").select(F.col("event_id").alias("k"), "event_type")
        rows = self._keyed().join(events, "k", "left")
        ticket_id = F.concat(F.lit("TKT-"), F.col("k").cast("string"))
        body = _body(F.col("text"), F.col("k"))
        age = (F.col("k") * 37) % (25 + 10 * _group(F.col("label"), F.col("k")))
        return rows.select(
            row_id(ticket_id).alias("id"),
            ticket_id.alias("ticket_id"),
            text.subject_from(body).alias("subject"),
            body.alias("description"),
            F.coalesce(_mapped(PRIORITY_OF_EVENT, F.col("event_type")), F.col("event_type")).alias("priority"),
            F.coalesce(_mapped(TYPE_OF_LANG, F.col("lang")), F.lit("")).alias("ticket_type"),
            F.coalesce("source", F.lit("")).alias("product_area"),
            F.lit("Open").alias("status"),
            F.coalesce("source", F.lit("manual")).alias("source"),
            (instant(AS_OF) - F.make_dt_interval(age.cast("int"))).alias("created_at"),
            "embedding",
            "k",
        )

    def tickets_by(self, **labels: Callable[[Column], Column]) -> DataFrame:
        """The number of ``tickets()`` for each value of some functions of the description.

        The labels are found where the texts are read: the joins carry no text, and rows that share a key meet as counts.
        """
        documents = self.table("documents").select("doc_id", _body(F.col("text"), F.col("doc_id")).alias("_body"))
        documents = documents.select("doc_id", *[f(F.col("_body")).alias(name) for name, f in labels.items()])
        documents = documents.groupBy("doc_id", *labels).agg(F.count("*").alias("n_documents"))
        vectors = self.table("embeddings").groupBy("vec_id").agg(F.count("*").alias("n_vectors"))
        events = self.table("events").groupBy(F.col("event_id").alias("k")).agg(F.count("*").alias("n_events"))
        keyed = documents.join(vectors, F.col("doc_id") == F.col("vec_id"), "full").withColumn("k", F.coalesce("doc_id", "vec_id"))
        rows = keyed.join(events, "k", "left").withColumn("_body", _body(F.lit(None).cast("string"), F.col("k")))
        found = [F.when(F.col("n_documents").isNull(), f(F.col("_body"))).otherwise(F.col(name)).alias(name) for name, f in labels.items()]
        one = F.lit(1).cast("bigint")
        tickets = F.coalesce("n_documents", one) * F.coalesce("n_vectors", one) * F.coalesce("n_events", one)
        return rows.select(*found, tickets.alias("n")).groupBy(*labels).agg(F.sum("n").alias("tickets"))

    def members(self) -> DataFrame:
        ticket_id = F.concat(F.lit("TKT-"), F.col("k").cast("string"))
        cluster = F.concat(F.lit("C0"), _group(F.col("label"), F.col("k")).cast("string"))
        score = 1 - F.pmod(F.col("k") * 13, F.lit(100)) / F.lit(1000.0)
        return self._keyed().select(
            row_id(ticket_id).alias("ticket_id"), cluster.alias("cluster_id"), F.round(score, 3).alias("similarity_score")
        )

    def bare_clusters(self) -> DataFrame:
        """The named clusters before any count."""
        rows = [(*c, 0, 0, 0, "Stable") for c in CLUSTER_NAMES]
        layout = "id string, name string, description string, ticket_count int, prev_window_count int, curr_window_count int, trend string"
        return self.spark.createDataFrame(rows, layout).withColumn("updated_at", instant("2024-01-01"))

    def clusters(self) -> DataFrame:
        """The named clusters with counts and trend as of the desk's day."""
        return refresh_trends(self.bare_clusters(), self.members(), self.tickets(), instant(AS_OF))

    def vectors(self) -> DataFrame:
        return self.table("embeddings").select("vec_id", "embedding", F.format_string("C%02d", "label").alias("cluster_id"))

    # --- the order desk ---

    def order_tickets(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"),
            F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("subject"),
        )

    def order_members(self) -> DataFrame:
        customer = self.table("customer").select("c_custkey", "c_nationkey")
        joined = self.table("orders").select("o_orderkey", "o_custkey").join(customer, F.col("o_custkey") == F.col("c_custkey"))
        return joined.select(
            F.col("o_orderkey").alias("ticket_id"), F.col("c_nationkey").alias("cluster_id"), F.lit(1.0).alias("similarity_score")
        )

    def order_clusters(self) -> DataFrame:
        return self.table("nation").select(
            F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit("").alias("description")
        )


def _group(label: Column, key: Column) -> Column:
    return F.coalesce(label.cast("bigint"), key % 10)


def _body(body: Column, key: Column) -> Column:
    """The text of a ticket, or one made from its key when there is none."""
    return F.coalesce(F.nullif(text.clean(body), F.lit("")), F.concat(F.lit("Ticket "), key.cast("string")))


def _mapped(pairs: dict[str, str], value: Column) -> Column:
    chain = F
    for old, new in pairs.items():
        chain = chain.when(value == old, new)
    return chain
