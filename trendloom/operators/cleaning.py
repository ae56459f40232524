"""From raw text rows to ticket rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import dates, ids, text


def with_text(rows: DataFrame, require: str = "either") -> DataFrame:
    """Rows that have a subject or a description; ``require='subject'`` asks for a subject."""
    return rows.filter(_has_text(require))


def rejected(rows: DataFrame, require: str = "either") -> DataFrame:
    """The rows that ``with_text`` drops."""
    return rows.filter(~_has_text(require))


def _has_text(require: str) -> Column:
    subject = text.clean(F.col("subject")) != ""
    return subject if require == "subject" else subject | (text.clean(F.col("description")) != "")


def clean_tickets(rows: DataFrame, as_of: Column, month: str | None = None, source: str = V.CSV_SOURCE) -> DataFrame:
    """Ticket rows of raw CSV rows: filled texts, defaults, valid priority, date and stable id.

    With a month, the id is unique within the month and every date falls into it. ``dated`` tells whether the row
    brought its own date; an upsert keeps the stored date where it did not.
    """
    cleaned = rows.select(
        *[text.clean(F.col(name)).alias(name) for name in V.CSV_COLUMNS if name in rows.columns],
        *[name for name in rows.columns if name not in V.CSV_COLUMNS],
    )
    blank = [F.lit("").alias(name) for name in V.CSV_COLUMNS if name not in rows.columns]
    c = cleaned.select("*", *blank)
    subject = text.filled_subject(F.col("subject"), F.col("description"))
    description = text.filled_description(F.col("subject"), F.col("description"))
    filled = c.withColumns({"description": description, "subject": subject})

    ticket_id = ids.stable_ticket_id(F.col("subject"), F.col("description"), F.col("raw_ticket_id"), month)
    if month:
        date = dates.parse_date(dates.coerce_to_month(F.col("date"), month))
    else:
        date = dates.parse_date(F.col("date"))
    return filled.select(
        ids.row_id(ticket_id).alias("id"),
        ticket_id.alias("ticket_id"),
        "subject",
        "description",
        text.valid_priority(F.col("priority")).alias("priority"),
        text.or_default(F.col("ticket_type"), V.DEFAULT_TICKET_TYPE).alias("ticket_type"),
        text.or_default(F.col("product_area"), V.DEFAULT_PRODUCT_AREA).alias("product_area"),
        F.lit(V.DEFAULT_STATUS).alias("status"),
        F.lit(source).alias("source"),
        F.coalesce(date, as_of).alias("created_at"),
        date.isNotNull().alias("dated"),
        *[name for name in rows.columns if name not in V.CSV_COLUMNS],
    )


def dataset_tickets(rows: DataFrame, as_of: Column) -> DataFrame:
    """Tickets of the public support dataset: padded ids, placeholders filled, status mapped."""
    ticket_id = ids.padded_ticket_id(F.col("raw_ticket_id"))
    return rows.select(
        ids.row_id(ticket_id).alias("id"),
        ticket_id.alias("ticket_id"),
        "subject",
        text.fill_placeholder(F.col("description"), F.col("product_area")).alias("description"),
        text.valid_priority(F.col("priority")).alias("priority"),
        "ticket_type",
        "product_area",
        text.mapped_status(F.col("status")).alias("status"),
        F.lit(V.DEFAULT_SOURCE).alias("source"),
        dates.created_at(F.col("date"), as_of).alias("created_at"),
    )


def streamed_tickets(parsed: DataFrame, as_of: Column) -> DataFrame:
    """Tickets of good JSON rows that already carry their nearest cluster and vector."""
    ticket_id = ids.webhook_ticket_id(F.col("id"))
    area = F.coalesce(F.col("product_area"), F.col("cluster_name"), F.lit(V.DEFAULT_PRODUCT_AREA))
    return parsed.select(
        ids.row_id(ticket_id).alias("id"),
        ticket_id.alias("ticket_id"),
        "subject",
        text.or_default(F.col("description"), F.col("subject")).alias("description"),
        text.valid_priority(F.coalesce(F.col("priority"), F.lit(V.DEFAULT_PRIORITY))).alias("priority"),
        F.coalesce(F.col("ticket_type"), F.lit(V.DEFAULT_TICKET_TYPE)).alias("ticket_type"),
        area.alias("product_area"),
        F.lit(V.DEFAULT_STATUS).alias("status"),
        F.lit(V.STREAM_SOURCE).alias("source"),
        as_of.alias("created_at"),
        "embedding",
        "cluster_id",
        "similarity_score",
    )


def next_numbered_ids(existing: DataFrame, incoming: DataFrame, order_by: str, floor: int = 1999) -> DataFrame:
    """Gives the incoming rows the ids that follow the highest ``TKT-`` number in use."""
    from .ranking import numbered

    highest = existing.agg(F.max(ids.id_number(F.col("ticket_id")))).first()[0]
    start = (floor if highest is None else highest) + 1
    rows = numbered(incoming, order_by, "_number", start)
    return rows.withColumn("ticket_id", ids.numbered_ticket_id(F.col("_number"))).drop("_number")
