"""Records of CSV files whose quoted fields may hold newlines, read by many tasks per file.

Spark's text reader cuts a file into splits and gives each task the lines of its own. Whether a line begins inside a
quoted field depends on all lines before it, but a split can only do one of few things to that state: so each split
first reports where it ends for either start, those reports are put together in the order of the splits (two numbers a
split), and then every split knows its start and can put its lines together to records. Records that run over the
end of a split leave a piece in each of them; only these pieces are shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_dir

CLOSING = re.compile(r'[^"]*(?:""[^"]*)*"(?!")')
WHOLE, HEAD, PIECE = 0, 1, 2
PLACE = "file string, block bigint, row bigint"


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a line leaves the reader inside a quoted field, when it begins inside or outside of one.

    A quote opens a field only at its start (white space aside) and is a letter elsewhere; two in a quoted field stand
    for one; after the closing quote all up to the next comma belongs to the field.
    """
    if '"' not in line:
        return inside
    at = 0
    while True:
        if inside:
            closed = CLOSING.match(line, at)
            if closed is None:
                return True
            at, inside = line.find(",", closed.end()) + 1, False
            if not at:
                return False
        quote = line.find('"', at)
        if quote < 0:
            return False
        before = line.rfind(",", at, quote) + 1 or at
        if line[before:quote].strip("".join(map(chr, range(33)))):
            at = line.find(",", quote) + 1
            if not at:
                return False
        else:
            at, inside = quote + 1, True


def lines_of(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, block, text) of every line, in order inside of each split. A byte order mark is not part of the first line."""
    lines = spark.read.option("lineSep", "\n").text(path)
    mark = (F.col("_metadata.file_block_start") == 0) & F.startswith("value", F.lit("﻿"))
    text = F.when(mark, F.substring("value", 2, 2**31 - 1)).otherwise(F.col("value"))  # only the first line can begin so
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), text.alias("text"))


def split_ends(lines: DataFrame) -> DataFrame:
    """(file, block, outside, inside): for every split with a quote, the state at its end for each state at its start."""

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends: dict[tuple[str, int], list[bool]] = {}  # in Spark one task reads few splits
        for batch in batches:
            for file, block, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                state = ends.setdefault((file, block), [False, True])
                first = ends_inside(line, state[0])
                state[:] = first, first if state[0] == state[1] else ends_inside(line, state[1])
        columns = [*zip(*ends, strict=True), *zip(*ends.values(), strict=True)] or [()] * 4
        kinds = (pa.string(), pa.int64(), pa.bool_(), pa.bool_())
        names = ["file", "block", "outside", "inside"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return lines.filter(F.contains("text", F.lit('"'))).mapInArrow(follow, "file string, block bigint, outside boolean, inside boolean")


def begun_inside(ends: DataFrame, lines: DataFrame) -> DataFrame:
    """(file, block) of the splits that begin inside a quoted field; block -1 for a file that ends inside of one."""
    splits = lines.select("file", "block").distinct().join(ends, ["file", "block"], "left")

    def carry(own: pd.DataFrame) -> pd.DataFrame:
        inside, found = False, []
        for split in own.sort_values("block").itertuples():
            if inside:
                found.append((split.file, split.block))
            if split.outside is not None:  # a split without quotes leaves the state as it is
                inside = split.inside if inside else split.outside
        if inside:
            found.append((own["file"].iloc[0], -1))
        return pd.DataFrame(found, columns=["file", "block"])

    return splits.groupBy("file").applyInPandas(carry, "file string, block bigint")


def pieces_of(lines: DataFrame) -> DataFrame:
    """(file, block, row, kind, text) of lines with ``begins_inside``: whole records, and the pieces of those that cross
    the end of a split. ``row`` numbers the records that begin in a split; a piece without a beginning has -1."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, row, inside, parts, kind = None, 0, False, [], WHOLE
        for batch in batches:
            out: list[tuple] = []

            def close(unfinished: bool) -> None:
                nonlocal row, parts, kind
                text = "\n".join(parts)
                if not unfinished:
                    text = text.removesuffix("\r")
                if kind == PIECE:
                    out.append((*split, -1, PIECE, text))
                elif text or unfinished:
                    out.append((*split, row, HEAD if unfinished else WHOLE, text))
                    row += 1
                parts, kind = [], WHOLE

            for file, block, line, begins in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (file, block) != split:
                    if parts:
                        close(unfinished=True)
                    split, row, inside = (file, block), 0, begins
                    kind = PIECE if begins else WHOLE
                parts.append(line)
                inside = ends_inside(line, inside)
                if not inside:
                    close(unfinished=False)
            yield table_of(out)
        out = []
        if parts:
            close(unfinished=True)
            yield table_of(out)

    return lines.mapInArrow(join, f"{PLACE}, kind int, text string")


def table_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string())
    columns = list(zip(*rows, strict=True)) or [()] * 5
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["file", "block", "row", "kind", "text"]
    )


def quoted_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, block, row, text): every record that is not empty, at the place where it begins.

    Records end with a newline, with or without a carriage return, outside of quotes; newlines inside stay as they are.
    """
    lines = lines_of(spark, path)
    # At most one row for each split; a split is a part of a file of up to spark.sql.files.maxPartitionBytes.
    path_of_splits = scratch_dir(spark, "csv-splits")
    begun_inside(split_ends(lines), lines).write.parquet(path_of_splits)
    inside = spark.read.schema("file string, block bigint").parquet(path_of_splits)
    if inside.isEmpty():  # no record crosses the end of a split
        return pieces_of(lines.withColumn("begins_inside", F.lit(False))).drop("kind")
    known = lines.join(F.broadcast(inside.withColumn("begins_inside", F.lit(True))), ["file", "block"], "left")
    known = known.select("file", "block", "text", F.coalesce("begins_inside", F.lit(False)).alias("begins_inside"))
    whole = pieces_of(known).filter(F.col("kind") == WHOLE).drop("kind")
    # The others are in files with such splits.
    crossed = known.join(F.broadcast(inside.select("file").distinct()), "file", "left_semi")
    order = Window.partitionBy("file").orderBy("block", "row").rowsBetween(Window.unboundedPreceding, 0)
    crossing = pieces_of(crossed).filter(F.col("kind") != WHOLE).withColumn("head", F.count_if(F.col("kind") == HEAD).over(order))
    parts = F.sort_array(F.collect_list(F.struct("block", "row", "text")))  # of one record
    joined = crossing.groupBy("file", "head").agg(parts.alias("parts")).select(
        "file", F.col("parts")[0]["block"].alias("block"), F.col("parts")[0]["row"].alias("row"),
        F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text"),
    )
    return whole.unionByName(joined)
