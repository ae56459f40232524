"""Table rules as one report, and the rows that break them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V

NOT_NULL = {
    "tickets": ("ticket_id", "subject", "description", "created_at"),
    "issue_clusters": ("name",),
    "cluster_members": ("ticket_id", "cluster_id"),
    "job_runs": ("job_type", "status", "started_at"),
}
ENUMS = {
    "tickets": {"priority": V.PRIORITIES},
    "issue_clusters": {"trend": V.TRENDS},
    "job_runs": {"job_type": V.JOB_TYPES, "status": V.JOB_STATUSES},
}
KEYS = {
    "tickets": (("id",), ("ticket_id",)),
    "issue_clusters": (("id",),),
    "cluster_members": (("ticket_id", "cluster_id"),),
    "job_runs": (("id", "status"),),  # a run leaves a row when it starts and one when it ends
}
VECTORS = {"tickets": "embedding", "issue_clusters": "centroid_embedding"}
FOREIGN_KEYS = (("ticket_id", "tickets"), ("cluster_id", "issue_clusters"))


def row_rules(table: str, dim: int) -> dict[str, Column]:
    """Rule name -> condition a row breaks it under."""
    rules = {f"not_null({c})": F.col(c).isNull() for c in NOT_NULL[table]}
    rules |= {f"enum({c})": ~F.col(c).isin(*allowed) for c, allowed in ENUMS.get(table, {}).items()}
    if table in VECTORS:
        rules[f"dimension({VECTORS[table]})"] = F.size(VECTORS[table]) != dim
    return rules


def check_rows(table: str, rows: DataFrame, dim: int = V.EMBEDDING_DIM) -> DataFrame:
    """(table, rule, violations) of all per-row rules, counted in one pass."""
    rules = row_rules(table, dim)
    counted = rows.agg(*[F.count_if(broken).alias(name) for name, broken in rules.items()])
    pairs = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"`{name}`").alias("violations")) for name in rules])
    return counted.select(F.lit(table).alias("table"), F.inline(pairs))


def duplicate_keys(rows: DataFrame, *key: str) -> DataFrame:
    """Keys held by more than one row."""
    return rows.groupBy(*key).agg(F.count("*").alias("rows")).filter(F.col("rows") > 1)


def check_key(table: str, rows: DataFrame, *key: str) -> DataFrame:
    """Violations of a unique key: the rows beyond the first of each key."""
    extra = duplicate_keys(rows.dropna(subset=list(key)), *key).agg(F.coalesce(F.sum(F.col("rows") - 1), F.lit(0)).alias("violations"))
    return extra.select(F.lit(table).alias("table"), F.lit(f"unique({', '.join(key)})").alias("rule"), "violations")


def orphans(members: DataFrame, column: str, parents: DataFrame) -> DataFrame:
    """References without a parent, with the number of member rows that hold them.

    Members are counted per reference first, so a reference held by very many rows is one row in the join.
    """
    references = members.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("rows"))
    return references.join(parents.select(F.col("id").alias(column)), column, "left_anti")


def constraint_report(tables: dict[str, DataFrame], dim: int = V.EMBEDDING_DIM) -> DataFrame:
    """(table, rule, violations) for the given tables."""
    parts = [check_rows(name, rows, dim) for name, rows in tables.items()]
    parts += [check_key(name, rows, *key) for name, rows in tables.items() for key in KEYS[name]]
    if "cluster_members" in tables:
        for column, parent in FOREIGN_KEYS:
            if parent in tables:
                lost = orphans(tables["cluster_members"], column, tables[parent])
                total = lost.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("violations"))
                parts.append(
                    total.select(
                        F.lit("cluster_members").alias("table"),
                        F.lit(f"foreign_key({column} -> {parent})").alias("rule"),
                        "violations",
                    )
                )
    return reduce(DataFrame.unionByName, parts)
