"""From a file of tickets to the stored table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import text
from ..operators import cleaning, models, ranking, upsert
from ..sources.csv_tickets import read_ticket_csv
from ..sources.jobs import job_run
from ..sources.store import TICKET_ORDER, TicketStore


def ticket_batch(raw: DataFrame, as_of: Column, month: str | None = None, require: str = "either") -> DataFrame:
    """Clean rows of a raw batch with the text to embed; duplicates are still inside (the upsert takes the last)."""
    tickets = cleaning.clean_tickets(cleaning.with_text(raw, require), as_of, month)
    embed_text = text.rich_embed_text(*[F.col(c) for c in ("subject", "description", "ticket_type", "product_area")])
    return tickets.withColumn("embed_text", embed_text)


def ingest_csv(
    spark: SparkSession, store: TicketStore, path: str | list[str], as_of: Column, month: str | None = None,
    model: models.Model | None = None, multiline: bool = True, require: str = "either", **embedding,
) -> dict[str, int]:
    """Reads, cleans, embeds and upserts a CSV batch; returns its counters."""
    with job_run(store, "csv_upload") as run:
        raw = read_ticket_csv(spark, path, multiline)
        counters, stored = Observation("rows"), Observation("stored")
        has_text = (F.col("subject") != "") if require == "subject" else (F.col("subject") != "") | (F.col("description") != "")
        raw = raw.observe(counters, F.count("*").alias("read"), F.count_if(has_text).alias("valid"))
        batch = ticket_batch(raw, as_of, month, require)
        # Duplicates and dates are settled before the model is asked, so every stored text is embedded once.
        unique = upsert.upsert_batch(store.read("tickets", "ticket_id", "created_at"), batch)
        unique = unique.observe(stored, F.count("*").alias("written"))
        store.upsert("tickets", models.embed_all(unique, "embed_text", model, **embedding))
        read, valid, written = counters.get["read"], counters.get["valid"], stored.get["written"]
        run.tickets_processed = written
    return {"read": read, "rejected": read - valid, "duplicates": valid - written, "written": written}


def append_tickets(store: TicketStore, tickets: DataFrame) -> int:
    """Appends ready ticket rows without a key check; returns how many."""
    written = Observation("appended")
    store.append("tickets", tickets.observe(written, F.count("*").alias("rows")))
    return written.get["rows"]


def add_tickets(store: TicketStore, incoming: DataFrame, order_by: str, as_of: Column, model: models.Model | None = None, **embedding) -> int:
    """Appends new tickets under the next free ``TKT-`` numbers."""
    from ..functions.ids import row_id

    rows = cleaning.next_numbered_ids(store.read("tickets", "ticket_id"), incoming, order_by)
    rows = rows.withColumns(
        {
            "id": row_id(F.col("ticket_id")),
            "embed_text": text.simple_embed_text(F.col("subject"), F.col("description")),
            "status": F.lit(V.DEFAULT_STATUS),
            "created_at": as_of,
        }
    )
    return append_tickets(store, models.embed_all(rows, "embed_text", model, **embedding))


def seed_dataset(
    spark: SparkSession, store: TicketStore, path: str, as_of: Column, n: int = 500, model: models.Model | None = None,
    truncate: bool = True, **embedding,
) -> None:
    """Stores a stratified sample of the public support dataset."""
    from ..operators.sampling import stratified_sample

    rows = ranking.last_per_id(read_ticket_csv(spark, path), "raw_ticket_id")
    tickets = cleaning.dataset_tickets(stratified_sample(rows, "subject", "raw_ticket_id", n), as_of)
    tickets = tickets.withColumn("embed_text", text.simple_embed_text(F.col("subject"), F.col("description"), ": "))
    embedded = models.embed_all(tickets, "embed_text", model, **embedding)
    if truncate:
        store.clear("issue_clusters", "cluster_members")
        store.replace("tickets", embedded, TICKET_ORDER)
    else:
        store.upsert("tickets", embedded)
