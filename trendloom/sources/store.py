"""Stored tables as Parquet folders.

Every write goes to a fresh folder and becomes visible by one appended row in the table of versions, so readers never
see half a write and a failed job leaves everything as it was. A small batch costs what the batch costs: it is stored
as a change beside the base, and readers put the two together. ``compact`` folds the changes into a new base.

A new base names the versions that it takes the place of, which are those that were visible when its rows were read.
All others stay visible, whenever they were staged or committed, so appends and upserts may overlap any write. Two
writers of bases of one table must not: the second one to commit raises.
"""

from __future__ import annotations

import time
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..operators.ranking import first_per_group

TABLE_SCHEMAS = {
    "tickets": schemas.TICKETS,
    "issue_clusters": schemas.CLUSTERS,
    "cluster_members": schemas.MEMBERS,
    "job_runs": schemas.JOB_RUNS,
}
TABLE_KEYS = {
    "tickets": ["ticket_id"], "issue_clusters": ["id"], "cluster_members": ["ticket_id", "cluster_id"], "job_runs": ["id"],
}
# Files then hold one source and a span of time each, so filters on either skip most of them; the id spreads a hot source.
TICKET_ORDER = ("source", "created_at", "ticket_id")
BASE, APPEND, UPSERT = "base", "append", "upsert"
_LOG = "table string, kind string, version bigint, replaces array<bigint>, committed_at timestamp"


class TicketStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # --- reading ---

    def read(self, table: str, *columns: str) -> DataFrame:
        """The current table, or an empty one. Name the columns needed; only those (and the key) are scanned."""
        plain, changed = self._current(table)
        rows = self._folders(table, plain)
        if changed:
            key = TABLE_KEYS[table]
            changes = self._folders(table, changed, with_version=True)
            place = F.array_position(F.array(*[F.lit(v) for v in changed]), F.col("version"))  # in order of commits
            latest = first_per_group(changes, key, [place.desc()]).drop("version")
            rows = rows.join(latest.select(*key), key, "left_anti").select(*rows.columns).unionByName(latest)
        return rows.select(*columns) if columns else rows

    def read_version(self, table: str, version: int) -> DataFrame:
        return self._folders(table, [version])

    def _current(self, table: str) -> tuple[list[int], list[int]]:
        """Versions of the base and what was appended, and of the upserts in the order of their commits."""
        try:
            log = self.spark.read.schema(_LOG).parquet(f"{self.root}/versions").filter(F.col("table") == table)
        except AnalysisException:
            return [], []
        entries = sorted(log.collect(), key=lambda r: (r["committed_at"], r["version"]))
        gone = {v for r in entries for v in r["replaces"] or ()}
        seen = [r for r in entries if r["version"] not in gone]
        return [r["version"] for r in seen if r["kind"] != UPSERT], [r["version"] for r in seen if r["kind"] == UPSERT]

    def visible(self, table: str) -> list[int]:
        """Versions that make up the table now; a base that is built from them replaces them."""
        plain, changed = self._current(table)
        return plain + changed

    def _folders(self, table: str, versions: list[int], with_version: bool = False) -> DataFrame:
        schema = TABLE_SCHEMAS[table]
        if with_version:
            schema = T.StructType(schema.fields + [T.StructField("version", T.LongType())])
        if not versions:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(schema)
        if with_version:
            reader = reader.option("basePath", f"{self.root}/{table}")
        return reader.parquet(*[self._path(table, v) for v in versions])

    def _path(self, table: str, version: int) -> str:
        return f"{self.root}/{table}/version={version}"

    # --- writing ---

    def stage(self, table: str, rows: DataFrame, order_by: tuple[str, ...] = ()) -> int:
        """Writes rows that nobody sees yet; returns their version.

        ``order_by`` range-partitions them (end it with a unique column, so that one hot value spreads), which lets
        later scans skip files by their statistics.
        """
        version = time.time_ns() // 1000
        if order_by:
            rows = rows.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
        self._matching(table, rows).write.parquet(self._path(table, version))
        return version

    def commit(self, *changes: tuple[str, str, int] | tuple[str, str, int, list[int]]) -> None:
        """Makes (table, kind, version) entries current, all at once: they are one file.

        A base brings the versions that it replaces. If one of them is gone, another base was committed meanwhile.
        """
        for table, kind, version, *replaced in changes:
            if kind == BASE and not replaced:
                raise ValueError(f"{table}: a base needs the versions that it replaces")
            if kind == BASE and not set(replaced[0]) <= set(self.visible(table)):
                raise RuntimeError(f"{table}: another base was committed while version {version} was written")
        now = datetime.now(timezone.utc)
        rows = [(table, kind, version, *(replaced or [[]]), now) for table, kind, version, *replaced in changes]
        self.spark.createDataFrame(rows, _LOG).coalesce(1).write.mode("append").parquet(f"{self.root}/versions")

    def replace(self, table: str, rows: DataFrame, order_by: tuple[str, ...] = (), replaces: list[int] | None = None) -> None:
        """A new base in place of what is visible at the call, or of the versions that the rows were read from."""
        replaces = self.visible(table) if replaces is None else replaces
        self.commit((table, BASE, self.stage(table, rows, order_by), replaces))

    def append(self, table: str, rows: DataFrame) -> None:
        self.commit((table, APPEND, self.stage(table, rows)))

    def upsert(self, table: str, rows: DataFrame) -> None:
        """Rows, unique by the table's key, that replace or join the stored ones."""
        self.commit((table, UPSERT, self.stage(table, rows)))

    def compact(self, table: str, order_by: tuple[str, ...] = ()) -> None:
        replaces = self.visible(table)
        self.replace(table, self.read(table), order_by, replaces)

    def clear(self, *tables: str) -> None:
        seen = {t: self.visible(t) for t in tables}
        empty = [(t, BASE, self.stage(t, self.spark.createDataFrame([], TABLE_SCHEMAS[t])), seen[t]) for t in tables]
        self.commit(*empty)

    def save_bucketed(self, table: str, key: str, name: str, buckets: int, *columns: str) -> DataFrame:
        """A catalog copy of some columns, bucketed and sorted by a key.

        Tickets by ``id`` and members by ``ticket_id`` in the same number of buckets join without a shuffle, which pays
        when several reports read one state of the desk.
        """
        rows = self.read(table, *columns)
        path = f"{self.root}/bucketed/{name}"
        rows.write.bucketBy(buckets, key).sortBy(key).mode("overwrite").option("path", path).saveAsTable(name)
        return self.spark.table(name)

    def register_views(self) -> None:
        for table in TABLE_SCHEMAS:
            self.read(table).createOrReplaceTempView(table)

    @staticmethod
    def _matching(table: str, rows: DataFrame) -> DataFrame:
        """The table's columns in its types; absent ones are NULL."""

        def column(field: T.StructField):
            present = field.name in rows.columns
            return (F.col(field.name) if present else F.lit(None)).cast(field.dataType).alias(field.name)

        return rows.select(*[column(f) for f in TABLE_SCHEMAS[table].fields])
