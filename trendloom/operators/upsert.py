"""Upserts. Both sides of every join are unique by key, so neither can be hot; a small batch is broadcast by its size
and the stored table is then scanned but not shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import first_per_group, last_per_id


def upsert_batch(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """What an upsert writes: the last incoming row of every ticket id, with the date to store.

    ``incoming`` has ``seq`` (input order) and ``dated``; a row without its own date keeps the stored date if there is one.
    """
    new = last_per_id(incoming)
    undated = new.filter(~F.col("dated")).select("ticket_id")
    stored = existing.select("ticket_id", F.col("created_at").alias("_stored")).join(undated, "ticket_id")
    kept = F.when(F.col("dated"), F.col("created_at")).otherwise(F.coalesce("_stored", "created_at"))
    dated = new.join(stored, "ticket_id", "left").withColumn("created_at", kept)
    return dated.drop("_stored", "seq", "dated")


def upsert_tickets(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """The whole table after the upsert: existing rows replaced by id, new ids added."""
    batch = upsert_batch(existing, incoming)
    columns = [c for c in existing.columns if c in batch.columns]
    untouched = existing.join(incoming.select("ticket_id").distinct(), "ticket_id", "left_anti")
    return untouched.select(*columns).unionByName(batch.select(*columns))


def upsert_members(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Members keyed by ticket and cluster; an incoming score replaces a stored one."""
    keys = ["ticket_id", "cluster_id"]
    new = first_per_group(incoming, keys, [F.col("similarity_score").desc()]).select(*keys, "similarity_score")
    untouched = existing.join(new.select(*keys), keys, "left_anti")
    return untouched.select(*keys, "similarity_score").unionByName(new)


def cascade(members: DataFrame, tickets: DataFrame, clusters: DataFrame) -> DataFrame:
    """Members that remain after their tickets or clusters were deleted."""
    in_tickets = members.join(tickets.select(F.col("id").alias("ticket_id")), "ticket_id", "left_semi")
    return in_tickets.join(clusters.select(F.col("id").alias("cluster_id")), "cluster_id", "left_semi")
