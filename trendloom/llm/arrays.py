"""Array expressions over whole texts, evaluated by Spark itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 256


def text_words(text: Column) -> Column:
    """Words between ASCII white space, in order."""
    bare = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def neighbours(array: Column, distance: int, combine: Callable[[Column, Column], Column]) -> Column:
    """``combine`` of each element and the one ``distance`` after it; shorter by ``distance``, empty if that is negative.

    The array should be a column, as it is read twice.
    """
    size = F.greatest(F.size(array) - distance, F.lit(0))
    return F.zip_with(F.slice(array, F.lit(1), size), F.slice(array, F.lit(distance + 1), size), combine)


def running_sums(lengths: Column) -> Column:
    """Sum of all elements before each position, and of all at the end (one element more than the input).

    Sums run within blocks and over blocks, so that the copies that growing an array costs stay near the input's size.
    """
    start = F.lit(0).cast("long")

    def grown(array: Column) -> Column:
        empty = F.struct(start.alias("total"), F.array().cast("array<bigint>").alias("sums"))
        return F.aggregate(
            array,
            empty,
            lambda acc, x: F.struct(
                (acc["total"] + x).cast("long").alias("total"), F.concat(acc["sums"], F.array(acc["total"] + x)).alias("sums")
            ),
        )

    blocks = F.when(
        F.size(lengths) > 0,
        F.transform(
            F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")),
            lambda b: grown(F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK))),
        ),
    ).otherwise(F.array().cast("array<struct<total:bigint,sums:array<bigint>>>"))
    before = F.aggregate(
        blocks,
        F.struct(start.alias("total"), F.array().cast("array<array<bigint>>").alias("sums")),
        lambda acc, b: F.struct(
            (acc["total"] + b["total"]).alias("total"),
            F.concat(acc["sums"], F.array(F.transform(b["sums"], lambda s: s + acc["total"]))).alias("sums"),
        ),
    )
    return F.concat(F.array(start), F.flatten(before["sums"]))


def covered(positions: Column, width: int | Column) -> Column:
    """How many places the stretches of ``width`` from the sorted positions cover together."""
    width = F.lit(width) if isinstance(width, int) else width
    return F.aggregate(
        positions,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda acc, p: F.struct(
            (acc["n"] + width - F.greatest(F.lit(0), acc["end"] - p)).cast("long").alias("n"), (p + width).cast("long").alias("end")
        ),
        lambda acc: acc["n"],
    )
