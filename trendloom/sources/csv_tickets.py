"""CSV ticket files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed_values as V
from ..functions.text import clean
from .quoted_csv import quoted_records

DIALECT = {"escape": '"', "ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True, "maxCharsPerColumn": -1}


def _reader(spark: SparkSession, multiline: bool):
    return spark.read.options(multiLine=multiline, **DIALECT)


def canonical_headers(headers: list[str]) -> list[str]:
    names = [(h or "").strip(V.WHITESPACE + '"').lower() for h in headers]
    return [V.COLUMN_ALIASES.get(n, n) for n in names]


def read_ticket_csv(
    spark: SparkSession, path: str | list[str], multiline: bool = True, require: tuple[str, ...] = ("subject", "description")
) -> DataFrame:
    """Rows of CSV files with one header layout (files with another one raise): the canonical text columns, trimmed, and ``seq``, the place in the input.

    Headers match by name, in any order and case; of two headers with one meaning the last counts. Unknown columns are
    not read. ``require`` names the columns of which at least one must be present. Files split between tasks, also in the
    full dialect, whose quoted fields may hold newlines; only a file with bare carriage returns as line ends is then
    read by one task. ``multiline=False`` reads the line dialect.
    """
    first = _reader(spark, multiline).csv(path).head(1)
    headers = canonical_headers(list(first[0])) if first else []
    if not set(headers) & set(require):
        found = ", ".join(headers) or "none"
        raise ValueError(f"CSV must contain at least one of these columns: {', '.join(require)}. Columns found: {found}")

    # Spark compares the header of every file with these names, so that files in another order raise instead of being
    # read by position. Headers that differ in case only have no such names; a folder of them must have one layout.
    given = [h or f"_c{i}" for i, h in enumerate(first[0])] if first else []
    distinct = len({g.lower() for g in given}) == len(given)
    names = given if distinct else [f"_c{i}" for i in range(len(given))]
    place = {name: F.col("`" + names[i].replace("`", "``") + "`") for i, name in enumerate(headers)}
    layout = T.StructType([T.StructField(name, T.StringType()) for name in names])
    if multiline and (line_end := _line_end(spark, path)) != "\r":
        records = quoted_records(spark, path)
        if line_end == "\r\n":  # as Spark's reader does, newlines inside of fields become plain ones
            records = records.withColumn("text", F.replace("text", F.lit("\r\n"), F.lit("\n")))
        rows = _parsed(records, layout, list(first[0]) if distinct else None)
    else:
        rows = _reader(spark, multiline).option("header", True).option("enforceSchema", not distinct).schema(layout).csv(path)
        seq = F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        )
        rows = rows.select("*", seq.alias("_seq"))
    columns = [
        clean(place[name]).alias(name) if name in place else F.lit("").alias(name) for name in V.CSV_COLUMNS
    ]
    return rows.select(*columns, F.col("_seq").alias("seq"))


def _line_end(spark: SparkSession, path: str | list[str]) -> str:
    """What ends the first line of the first file."""
    first = spark.read.option("lineSep", "\n").text(path).head()
    line = first[0] if first else ""
    return "\r" if "\r" in line.rstrip("\r") else "\r\n" if line.endswith("\r") else "\n"


def _parsed(records: DataFrame, layout: T.StructType, given: list[str | None] | None) -> DataFrame:
    """The fields of every record but the headers, and ``_seq``, its place. Headers that differ from ``given`` raise."""
    options = {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in DIALECT.items()}
    plain = ", ".join(f"c{i} string" for i in range(len(layout)))
    # INLINE binds the fields, so that no filter above repeats the parsing.
    fields = F.from_csv("text", F.lit(plain), {**options, "multiLine": "true"})
    read = records.select("file", "block", "row", F.inline(F.array(fields)))
    header = (F.col("block") == 0) & (F.col("row") == 0)
    if given is not None:
        same = F.lit(True)
        for i, name in enumerate(given):
            same &= F.col(f"c{i}").eqNullSafe(F.lit(name).cast("string"))
        error = F.raise_error(F.concat(F.lit("another header than the first file: "), "file")).cast("boolean")
        header = F.when(header & ~same, error).otherwise(header)
    seq = F.struct("file", "block", "row").alias("_seq")
    return read.filter(~header).select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(layout.names)], seq)
