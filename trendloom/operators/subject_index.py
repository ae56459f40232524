"""Substring search over subjects by stored trigram postings.

Different subjects are stored once, in lower case, with the three-letter pieces that they hold and the tickets that have
them. A search looks up the rarest pieces of the text, checks the subjects that hold all of these by the text itself, and
reads the tickets of those that contain it. Every table is partitioned by a short hash of its key, so a search lists and
reads only the partitions of the keys it needs.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LETTERS = 3
ROWS_PER_BUCKET = 200_000  # tickets; the tables get a partition for as many
MAX_BUCKETS = 256
RAREST = 4  # pieces of a text whose postings are read; the others are left to the check of the text


def grams_of(text: Column) -> Column:
    """The different pieces of a text; none of a shorter one."""
    places = F.sequence(F.lit(1), F.length(text) - (LETTERS - 1))
    return F.when(F.length(text) >= LETTERS, F.array_distinct(F.transform(places, lambda i: F.substring(text, i, F.lit(LETTERS)))))


TABLES = {
    "links": "sid string, ticket_id {key}, bucket int", "subjects": "sid string, subject string, bucket int",
    "postings": "sid string, gram string, bucket int", "grams": "gram string, subjects bigint, bucket int",
}


def bucket_of(text: str, buckets: int) -> int:
    return zlib.crc32(text.encode()) % buckets


def bucket_column(text: str, buckets: int) -> Column:
    return F.pmod(F.crc32(F.encode(text, "utf-8")), F.lit(buckets)).cast("int")


class SubjectIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.buckets, key = spark.read.parquet(f"{path}/layout").first()
        for name, layout in TABLES.items():
            setattr(self, name, spark.read.schema(layout.format(key=key)).parquet(f"{path}/{name}"))

    @classmethod
    def build(cls, tickets: DataFrame, path: str, key: str = "id", subject: str = "subject", buckets: int | None = None) -> SubjectIndex:
        """Writes the index to a new folder. Tickets without subject are in none of its answers."""
        spark = tickets.sparkSession
        rows = tickets.filter(F.col(subject).isNotNull()).select(F.col(key).alias("ticket_id"), F.lower(subject).alias("subject"))
        buckets = buckets or max(1, min(MAX_BUCKETS, rows.count() // ROWS_PER_BUCKET))
        rows = rows.withColumn("sid", F.md5("subject")).withColumn("bucket", bucket_column("sid", buckets))

        def write(frame: DataFrame, name: str) -> DataFrame:
            # REBALANCE keeps a partition together and lets Spark cut one that holds very many rows.
            frame.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{path}/{name}")
            return spark.read.schema(frame.schema).parquet(f"{path}/{name}")

        write(rows.select("sid", "ticket_id", "bucket"), "links")
        subjects = write(rows.select("sid", "subject", "bucket").distinct(), "subjects")
        pieces = subjects.select("sid", F.explode(grams_of(F.col("subject"))).alias("gram"))
        postings = write(pieces.withColumn("bucket", bucket_column("gram", buckets)), "postings")
        write(postings.groupBy("gram", "bucket").agg(F.count("*").alias("subjects")), "grams")
        layout = [(buckets, rows.schema["ticket_id"].dataType.simpleString())]
        spark.createDataFrame(layout, "buckets int, key string").coalesce(1).write.parquet(f"{path}/layout")
        return cls(spark, path)

    def candidates(self, text: str) -> DataFrame | None:
        """(sid) of the subjects that hold the rarest pieces of a lower-case text; None when it has no whole piece."""
        pieces = sorted({text[i : i + LETTERS] for i in range(len(text) - LETTERS + 1)})
        if not pieces:
            return None
        held = self._of(self.grams, pieces).collect()  # at most one row for each piece of the text
        if len(held) < len(pieces):
            return self.postings.select("sid").limit(0)
        rare = [r["gram"] for r in sorted(held, key=lambda r: (r["subjects"], r["gram"]))[:RAREST]]
        found = self._of(self.postings, rare).groupBy("sid").agg(F.count("*").alias("n"))
        return found.filter(F.col("n") == len(rare)).select("sid")

    def _of(self, table: DataFrame, pieces: list[str]) -> DataFrame:
        return table.filter(F.col("bucket").isin(sorted({bucket_of(p, self.buckets) for p in pieces})) & F.col("gram").isin(pieces))

    def tickets_with(self, text: str) -> DataFrame:
        """(ticket_id) of the tickets whose subject contains the text, case ignored."""
        text = text.lower()
        subjects, found = self.subjects, self.candidates(text)
        if found is not None:
            subjects = self._in_buckets(subjects, found).join(found, "sid", "left_semi")
        hits = subjects.filter(F.contains("subject", F.lit(text))).select("sid")
        return self._in_buckets(self.links, hits).join(hits, "sid", "left_semi").select("ticket_id")

    def _in_buckets(self, table: DataFrame, sids: DataFrame) -> DataFrame:
        """The partitions of some subjects."""
        held = [r[0] for r in sids.select(bucket_column("sid", self.buckets)).distinct().collect()]  # MAX_BUCKETS rows at most
        return table.filter(F.col("bucket").isin(held or [-1]))
