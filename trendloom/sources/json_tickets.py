"""JSON tickets, one object per text row, from a batch or a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas

BAD_JSON = "Invalid JSON body"
MISSING_FIELDS = "`id` and `subject` are required"
_CORRUPT = "_corrupt"


def read_json_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Arriving JSON-lines files as one text column ``payload``."""
    reader = spark.readStream.schema("value string").option("maxFilesPerTrigger", max_files)
    return reader.text(path).select(F.col("value").alias("payload"))


def parse_tickets(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Adds the ticket fields, and ``error``: NULL for a good row."""
    schema = T.StructType(schemas.JSON_TICKET.fields + [T.StructField(_CORRUPT, T.StringType())])
    parsed = F.from_json(F.col(payload), schema, {"columnNameOfCorruptRecord": _CORRUPT})
    rows = payloads.withColumn("_t", parsed)
    fields = [F.col(f"_t.{name}").alias(name) for name in schemas.JSON_TICKET.names]
    return rows.select(*payloads.columns, *fields, _error().alias("error"))


def _error() -> Column:
    def empty(name: str) -> Column:
        return F.coalesce(F.col(f"_t.{name}"), F.lit("")) == ""

    malformed = F.col("_t").isNull() | F.col(f"_t.{_CORRUPT}").isNotNull()
    return F.when(malformed, BAD_JSON).when(empty("id") | empty("subject"), MISSING_FIELDS)
