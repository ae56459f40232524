"""Vectors in cells: a stored index, and top-k similarity of two large tables.

The cells are those of K-Means centres that are fitted to a bounded sample; every vector goes to its nearest centre. A
cell keeps the widest angle between its centre and one of its vectors. Angles keep the triangle inequality, so no vector
of a cell is nearer to a query than the angle to the centre less that width: a cell whose best possible cosine is below
what a query already has cannot hold a match and is not read. ``VectorIndex`` stores the cells as partitions, so cells
that are left out are not even listed in the scan.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import vectors
from ..session import scratch_dir
from . import similarity
from .ranking import top_per_group

SAMPLE_NUMBERS = 4_000_000  # numbers of the sampled vectors that centres are fitted to
MAX_CELLS = 1024
FIT_ROUNDS = 8
CALIBRATION_QUERIES = 64
LEAST_BLOCKS = 8  # of the larger side, if a block then has LEAST_BLOCK vectors
LEAST_BLOCK = 1000
MARGIN = 1e-7  # of angles, for the rounding of scores: near 1, cosines that differ by 1e-12 are 1e-6 apart as angles


def whole_vectors(rows: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """(key, v) of the finite vectors of one length."""
    values = rows.select(F.col(key).alias("key"), vectors.as_doubles(F.col(vector)).alias("v")).filter(F.col("key").isNotNull())
    finite = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return values.filter(F.coalesce(F.size("v") == dim, F.lit(False))).filter(finite)


def fitted_centres(values: DataFrame, cells: int, dim: int, seed: int = V.KMEANS_SEED) -> np.ndarray:
    """Unit centres of a sample in the order of a hash of the key, so that they repeat."""
    size = max(cells, min(64 * cells, SAMPLE_NUMBERS // dim))
    sample = values.filter(F.exists("v", lambda x: x != 0)).orderBy(F.xxhash64("key"), "key").limit(size).select("v").toPandas()
    if sample.empty:
        return np.eye(1, dim)
    units = vectors.unit_rows(np.stack(sample["v"].to_list()))
    centres = units[np.random.default_rng(seed).permutation(len(units))[:cells]]
    for _ in range(FIT_ROUNDS):
        own = (units @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, units)
        moved = vectors.unit_rows(sums)
        centres = np.where((moved != 0).any(axis=1, keepdims=True), moved, centres)
    return centres


def in_cells(values: DataFrame, centres: np.ndarray) -> DataFrame:
    """The rows with their cell and the cosine to its centre; a narrow step."""
    found = values.withColumn("_near", vectors.nearest_row(F.col("v"), centres))
    return found.select("*", F.col("_near.row").alias("cell"), F.col("_near.score").alias("to_centre")).drop("_near")


class Cells:
    """Centres of the cells that hold vectors, how far each reaches, and how many vectors it holds."""

    def __init__(self, centres: np.ndarray, rows: pd.DataFrame):
        """``rows`` has one row a cell: cell, least (cosine to the centre) and size."""
        rows = rows.sort_values("cell")
        self.ids = rows["cell"].to_numpy()
        self.sizes = rows["size"].to_numpy()
        self.centres = centres[self.ids]
        # A zero vector has cosine 0 with everything, so 0 is always possible in a cell that holds one.
        self.zero = rows["zero"].to_numpy(dtype=bool)
        self.width = np.arccos(np.clip(rows["least"].to_numpy(dtype=float) - 1e-11, -1, 1))

    @classmethod
    def of(cls, placed: DataFrame, centres: np.ndarray) -> Cells:
        is_zero = ~F.exists("v", lambda x: x != 0)
        stats = placed.groupBy("cell").agg(
            F.coalesce(F.min(F.when(~is_zero, F.col("to_centre"))), F.lit(1.0)).alias("least"), F.count("*").alias("size"), F.max(is_zero).alias("zero")
        )
        return cls(centres, stats.toPandas())  # MAX_CELLS rows at most

    def bounds(self, units: np.ndarray, position: int | None = None) -> np.ndarray:
        """Best possible cosine of every unit query with a vector of each cell, or of the cell at one position."""
        some = slice(None) if position is None else slice(position, position + 1)
        zero = self.zero[some]
        angle = np.arccos(np.clip(units @ self.centres[some].T, -1, 1))
        best = np.cos(np.maximum(angle - self.width[some] - MARGIN, 0.0))
        best[:, zero] = np.maximum(best[:, zero], 0.0)
        best[~(units != 0).any(axis=1)] = 0.0
        return best + 1e-11


# --- stored index --------------------------------------------------------------------------------------------------


class VectorIndex:
    """Inverted lists in a folder, one partition a cell. Ids and vectors only; rows are fetched by id from the table.

    ``search`` reads the cells nearest to the query. How many, is found when the index is built: as many as it takes to
    hold a given share of the true neighbours of some vectors of the table. ``exact=True`` goes on to all cells that the
    bound does not leave out, which gives the rows of a scan of the whole table.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        rows = spark.read.parquet(f"{path}/cells").toPandas()  # MAX_CELLS rows at most
        self.dim, self.probes = int(rows["dim"].iloc[0]), int(rows["probes"].iloc[0])
        centres = np.zeros((int(rows["cell"].max()) + 1, self.dim))
        centres[rows["cell"]] = np.stack(rows["centre"].to_list())
        self.cells = Cells(centres, rows)
        self.lists = spark.read.parquet(f"{path}/lists")

    @classmethod
    def build(
        cls, table: DataFrame, path: str, dim: int | None = None, cells: int | None = None, recall: float = 0.95, key: str = "id",
        vector: str = "embedding", k: int = V.SIMILARITY_LIMIT,
    ) -> VectorIndex | None:
        """Writes the index of all vectors of one length (by default the commonest) to a new folder; None if there are none."""
        spark = table.sparkSession
        if dim is None:
            sizes = table.filter(F.size(vector) > 0).groupBy(F.size(vector).alias("dim")).count().orderBy(F.col("count").desc(), "dim").first()
            if sizes is None:
                return None
            dim = sizes["dim"]
        values = whole_vectors(table, key, vector, dim)
        number = values.count()
        if not number:
            return None
        cells = cells or max(1, min(MAX_CELLS, round(math.sqrt(number))))
        centres = fitted_centres(values, cells, dim)
        # REBALANCE writes each cell together, and lets Spark cut a cell that holds very many rows into several files.
        placed = in_cells(values, centres).hint("rebalance", "cell")
        placed.select("key", "v", "to_centre", "cell").write.partitionBy("cell").parquet(f"{path}/lists")
        placed = spark.read.parquet(f"{path}/lists")
        found = Cells.of(placed, centres)
        probes = cls._calibrated(placed, found, recall, k)
        rows = [
            (int(c), [float(x) for x in centre], float(math.cos(w)), int(n), bool(z), dim, probes)
            for c, centre, w, n, z in zip(found.ids, found.centres, found.width, found.sizes, found.zero, strict=True)
        ]
        layout = "cell int, centre array<double>, least double, size bigint, zero boolean, dim int, probes int"
        spark.createDataFrame(rows, layout).coalesce(1).write.parquet(f"{path}/cells")
        return cls(spark, path)

    @staticmethod
    def _calibrated(placed: DataFrame, cells: Cells, recall: float, k: int) -> int:
        """The least number of nearest cells that hold the share of the k best vectors of some queries."""
        sample = placed.orderBy(F.xxhash64("key"), "key").limit(CALIBRATION_QUERIES).select("key", "v").toPandas()
        queries = placed.sparkSession.createDataFrame(list(enumerate(sample["v"].to_list())), "query_id int, embedding array<double>")
        best = similarity.similar_topk(placed, queries, k, None, "key", "v")
        hits = best.join(placed.select(F.col("key").alias("match_id"), "cell"), "match_id").select("query_id", "cell").toPandas()
        order = np.argsort(-cells.bounds(vectors.unit_rows(np.stack(sample["v"].to_list()))), axis=1, kind="stable")
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], axis=1)
        ranks = place[hits["query_id"].to_numpy(), np.searchsorted(cells.ids, hits["cell"].to_numpy())]
        return int(np.quantile(ranks, recall, method="higher")) + 1

    def search(
        self, query: list[float], threshold: float = V.SIMILARITY_THRESHOLD, limit: int = V.SIMILARITY_LIMIT, exact: bool = False
    ) -> DataFrame:
        """(key, similarity), best first: the found rows above the threshold, ties by key, at most ``limit``."""
        unit = vectors.unit_rows(np.array([query], dtype=np.float64))
        if len(query) != self.dim:
            return self.lists.select("key", F.lit(0.0).alias("similarity")).limit(0)
        bound = self.cells.bounds(unit)[0]
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > threshold]
        found = self._scan(unit, order[: self.probes], threshold, limit)
        if exact:
            near = found.toPandas()  # `limit` rows at most
            floor = near["similarity"].min() if len(near) == limit else threshold
            further = order[self.probes :]
            further = further[bound[further] >= floor]
            if len(further):
                found = found.unionByName(self._scan(unit, further, threshold, limit))
        return found.orderBy(F.col("similarity").desc(), "key").limit(limit)

    def _scan(self, unit: np.ndarray, cells: np.ndarray, threshold: float, limit: int) -> DataFrame:
        lists = self.lists.filter(F.col("cell").isin([int(c) for c in self.cells.ids[cells]]) if len(cells) else F.lit(False))
        one = similarity.SmallVectors([0], unit)
        best = similarity._scan_topk(lists, one, limit, threshold, "key", "v", "int")
        return best.select(F.col("match_id").alias("key"), "similarity")


def find_similar_indexed(tickets: DataFrame, index: VectorIndex, query: list[float], **options) -> DataFrame:
    """``similarity.find_similar`` by the index: the columns come from the tickets, for the winners only."""
    fields = ["id", "ticket_id", "subject", "description", "priority", "ticket_type", "product_area", "created_at"]
    winners = index.search(query, **options).withColumnRenamed("key", "id")  # `limit` rows at most
    return tickets.select(*fields).join(F.broadcast(winners), "id").orderBy(F.col("similarity").desc(), "id")


# --- two large tables ----------------------------------------------------------------------------------------------


def pruned_topk(
    corpus: DataFrame, queries: DataFrame, k: int, threshold: float | None, corpus_id: str, corpus_vector: str, query_id: str,
    query_vector: str,
) -> DataFrame:
    """``similarity.similar_topk`` for two large sides: (query_id, match_id, similarity, rank).

    A query first meets its own cell; what it finds there says which other cells can still hold a match, and it meets
    those. Cells are put together in blocks of bounded size, and a query travels once to each block that has a cell it
    wants, not to each cell; inside, it meets only these cells. Large cells and the queries of a block are dealt to groups of
    bounded size, so neither side is gathered in a task.
    """
    dims = [r[0] for r in queries.select(F.size(query_vector).alias("n")).filter("n > 0").distinct().collect()]
    parts = [
        _pruned_of_length(whole_vectors(corpus, corpus_id, corpus_vector, dim), whole_vectors(queries, query_id, query_vector, dim), k, threshold, dim)
        for dim in sorted(dims)
    ]
    kinds = (queries.schema[query_id].dataType.simpleString(), corpus.schema[corpus_id].dataType.simpleString())
    none = corpus.sparkSession.createDataFrame([], f"query_id {kinds[0]}, match_id {kinds[1]}, similarity double")
    return similarity._overall(reduce(DataFrame.unionByName, parts, none), k)


def _stored(rows: DataFrame, purpose: str) -> DataFrame:
    path = scratch_dir(rows.sparkSession, purpose)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _pruned_of_length(corpus: DataFrame, queries: DataFrame, k: int, threshold: float | None, dim: int) -> DataFrame:
    first, further, meet = first_round(corpus, queries, k, threshold, dim)
    return first if further is None else first.unionByName(meet(further))


class Blocks:
    """Cells put together until a block has ``most`` vectors; a larger cell is a block of several parts."""

    def __init__(self, cells: Cells, most: int):
        self.of_cell = np.zeros(len(cells.ids), dtype=np.int64)  # by position of the cell
        self.sizes: list[int] = []
        for position, size in enumerate(cells.sizes):
            if not self.sizes or self.sizes[-1] + size > most:
                self.sizes.append(0)
            self.sizes[-1] += int(size)
            self.of_cell[position] = len(self.sizes) - 1
        self.parts = [-(-size // most) for size in self.sizes]


def first_round(
    corpus: DataFrame, queries: DataFrame, k: int, threshold: float | None, dim: int
) -> tuple[DataFrame, DataFrame | None, Callable[[DataFrame], DataFrame]]:
    """What queries find in their own cells, their further visits (block, key, v, floor, home), and what carries visits out."""
    spark, kinds = corpus.sparkSession, [s.schema["key"].dataType.simpleString() for s in (queries, corpus)]
    result = f"query_id {kinds[0]}, match_id {kinds[1]}, similarity double"
    rows = corpus.count()
    if not rows:
        return spark.createDataFrame([], result), None, lambda visiting: spark.createDataFrame([], result)
    # Blocks small enough for memory, and so many that all tasks have work.
    per_group = max(1, min(similarity.BLOCK_CELLS // dim, max(LEAST_BLOCK, -(-max(rows, queries.count()) // LEAST_BLOCKS))))
    centres = fitted_centres(corpus, max(1, min(MAX_CELLS, max(4 * -(-rows // per_group), round(math.sqrt(rows))))), dim)
    placed = _stored(in_cells(corpus, centres), "cells")
    cells = Cells.of(placed, centres)
    blocks = Blocks(cells, per_group)
    slice_rows = max(1, similarity.SCORES_AT_ONCE // len(cells.ids))

    def routed(batches: Iterator[pa.RecordBatch], home: bool) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, slice_rows):  # bounds of a slice at once, and a batch of a block at once
                batch = whole.slice(start, slice_rows)
                floor = batch.column(2).to_numpy(zero_copy_only=False)
                bounds = cells.bounds(vectors.unit_rows(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)))
                best = bounds.argmax(axis=1)
                wanted = np.zeros(bounds.shape, dtype=bool) if home else bounds >= floor[:, None]
                wanted[np.arange(len(best)), best] = home
                for block in range(len(blocks.sizes)):
                    at = pa.array(np.flatnonzero(wanted[:, blocks.of_cell == block].any(axis=1)))
                    if len(at):
                        columns = [batch.column(i).take(at) for i in range(3)]
                        homes = pa.array(best, pa.int32()).take(at)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([block] * len(at), pa.int32()), *columns, homes], names=["block", "key", "v", "floor", "home"]
                        )

    def visits(asked: DataFrame, home: bool) -> DataFrame:
        route = lambda batches: routed(batches, home)
        return asked.select("key", "v", "floor").mapInArrow(route, f"block int, key {kinds[0]}, v array<double>, floor double, home int")

    def pair(matches: pd.DataFrame, wanted: pd.DataFrame, home: bool) -> pd.DataFrame:
        none = pd.DataFrame({c: pd.Series([], dtype=object) for c in ("query_id", "match_id", "similarity")})
        if matches.empty or wanted.empty:
            return none
        units, floor, homes = vectors.unit_rows(np.stack(wanted["v"].to_list())), wanted["floor"].to_numpy(), wanted["home"].to_numpy()
        best = similarity._Best(units, k, threshold, floor)
        for cell, own in matches.groupby("cell"):
            position = int(np.searchsorted(cells.ids, cell))
            asks = homes == position
            if not home:
                asks = ~asks & (cells.bounds(units, position)[:, 0] >= best.floor)
            if len(asking := np.flatnonzero(asks)):
                best.add(own["key"].to_numpy(), np.stack(own["v"].to_list()), asking)
        found = best.rows()
        if found.empty:
            return none
        ids = wanted["key"].to_numpy()[found["query"].to_numpy(dtype=np.int64)]
        return pd.DataFrame({"query_id": ids, "match_id": found["match"].to_numpy(), "similarity": found["score"].to_numpy()})

    def meet(visiting: DataFrame, home: bool = False) -> DataFrame:
        counts = {r["block"]: r["count"] for r in visiting.groupBy("block").count().collect()}  # at most one row per cell
        layout = [(b, blocks.parts[b], -(-n // per_group)) for b, n in counts.items()]
        sizes = F.broadcast(spark.createDataFrame(layout, "block int, parts int, slices int"))
        block_of = F.broadcast(spark.createDataFrame([(int(c), int(b)) for c, b in zip(cells.ids, blocks.of_cell)], "cell int, block int"))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        own = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
        left = placed.join(block_of, "cell").join(sizes, "block").withColumn("part", own("parts")).withColumn("slice", every("slices"))
        right = visiting.join(sizes, "block").withColumn("slice", own("slices")).withColumn("part", every("parts"))
        group = ("block", "part", "slice")
        left, right = left.select(*group, "cell", "key", "v"), right.select(*group, "key", "v", "floor", "home")
        paired = lambda matches, wanted: pair(matches, wanted, home)
        return left.groupBy(*group).cogroup(right.groupBy(*group)).applyInPandas(paired, result)

    lowest = -2.0 if threshold is None else threshold
    first_visits = _stored(visits(queries.withColumn("floor", F.lit(lowest)), home=True), "visits")
    first = _stored(meet(first_visits, home=True), "first")
    kth = top_per_group(first, ["query_id"], [F.col("similarity").desc(), F.col("match_id")], k).groupBy("query_id").agg(
        F.when(F.count("*") == k, F.min("similarity")).alias("kth")
    )
    known = queries.join(kth.withColumnRenamed("query_id", "key"), "key", "left")
    known = _stored(known.withColumn("floor", F.greatest(F.coalesce("kth", F.lit(lowest)), F.lit(lowest))), "floors")
    return first, visits(known, home=False), meet  # visits are many times the table, so they are not stored
