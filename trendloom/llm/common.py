"""Helpers that the operators share."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.session import scratch_dir

# One Arrow batch holds texts of this many rows at most; a batch of very long texts must fit a Python worker.
BATCH_ROWS = 256


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(frame: DataFrame, purpose: str) -> DataFrame:
    """The rows, written once to the shared scratch folder and read back: later steps neither repeat the work nor
    depend on an executor that may be lost."""
    spark = frame.sparkSession
    path = scratch_dir(spark, purpose)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bounds Arrow batches by rows, so that long texts fit a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def in_slices(convert: Callable[..., pa.Array], *columns: pa.Array) -> pa.Array:
    """``convert`` of the columns of an Arrow batch, a few rows at a time: only their Python objects are held at once."""
    starts = range(0, max(1, len(columns[0])), BATCH_ROWS)
    return pa.concat_arrays([convert(*(c.slice(at, BATCH_ROWS) for c in columns)) for at in starts])


def whole_text(text: str | Column = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def unused(frame: DataFrame, name: str) -> str:
    """The name of a helper column that the table does not have."""
    taken = {c.lower() for c in frame.columns}
    while name in taken:
        name = f"_{name}"
    return name


def row_key(*columns: str) -> Column:
    """256-bit digest of the columns: rows with the same values share it. Null and empty differ."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns]
    sized = [F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts]
    return F.unhex(F.sha2(F.concat(*sized), 256))


def sha256_of(items: Column) -> Column:
    """Lowercase hex SHA-256 of the strings joined by commas."""
    return F.sha2(F.array_join(items, ","), 256)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether the row is kept out of training: crc32 of the id as text leaves 2 when divided by 4. A null id counts as
    empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 4 == 2


def training_labels(labels: DataFrame, name: str, most: int) -> DataFrame:
    """Rows (doc_id, label) to learn from: at most ``most``, those whose ids hash least, never held-out ones.

    Labels other than 0 and 1, and rows without id, are left out; an id with both labels counts as 1.
    """
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col(name).isin(0, 1) & ~held_out("doc_id"))
    one_each = usable.groupBy("doc_id").agg(F.max(name).cast("int").alias("label"))
    return one_each.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
