"""Ticket ids. All are functions of the data, so a replay gives the same ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def row_id(natural_key: Column) -> Column:
    """The surrogate key of a row, from its natural key."""
    return F.md5(natural_key)


def stable_ticket_id(subject: Column, description: Column, raw_id: Column | None = None, month: str | None = None) -> Column:
    """``CSV-`` and 16 hex digits of the native id, or of the texts where there is none, within the month if given."""
    key = F.concat(subject, F.lit("|"), description)
    if raw_id is not None:
        key = F.when(F.coalesce(raw_id, F.lit("")) != "", raw_id).otherwise(key)
    if month:
        key = F.concat(F.lit(month + "|"), key)
    return F.concat(F.lit("CSV-"), F.substring(F.md5(key), 1, 16))


def upload_ticket_id(batch_millis: int, position: Column) -> Column:
    return F.concat(F.lit(f"CSV-{batch_millis}-"), position.cast("string"))


def webhook_ticket_id(external_id: Column) -> Column:
    return F.concat(F.lit("WH-"), external_id)


def padded_ticket_id(native_id: Column, prefix: str = "KT-", width: int = 5) -> Column:
    """Zero-padded to the width; longer ids are kept whole."""
    text = native_id.cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text))


def numbered_ticket_id(number: Column, prefix: str = "TKT-") -> Column:
    return F.concat(F.lit(prefix), number.cast("string"))


def id_number(ticket_id: Column, prefix: str = "TKT-") -> Column:
    """The number of an id of the given scheme, else NULL."""
    tail = F.substring(ticket_id, len(prefix) + 1, 64)
    return F.when(ticket_id.startswith(prefix), tail.try_cast("bigint"))
