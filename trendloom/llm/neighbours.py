"""Nearest vectors by inner product: stable projections, kd-trees, and verification until a chi-square test stops it.

With one more coordinate every vector gets the largest length M of the table, and a query is scaled to that length: the
squared distance is then 2 M M - 2 M score / |query|, so the nearest vectors have the largest inner products. Gaussian
projections to ``PROJECTED`` numbers are stable: the squared projected distance is the squared distance times a
chi-square variable of that many degrees. A query takes vectors in the order of their projected distance and verifies
them by the true product. It stops when the next projected distance is so large that a vector as near as its k-th best
would lie this far out with a probability of ``1 - CONFIDENCE`` only.

In Spark, a kd-tree over the projections of a bounded sample cuts space into cells. Every vector goes to its cell, large
cells are dealt to several parts by hash, and each part gets its own kd-tree inside a task. A query first searches its own cell;
its k-th best score there says which other cells the test cannot leave out, and it visits those. Equal vectors are one
class with its smallest ids, so a vector that very many rows share is searched, and searches, once.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trendloom.llm.common import stored

TOP = 20
PROJECTED = 12  # degrees of freedom; an even number
CONFIDENCE = 0.95
SEED = 42
SAMPLE_NUMBERS = 1 << 19  # numbers of the sampled vectors that the cells are cut by: 8192 vectors of 64
PART_NUMBERS = 1 << 20  # numbers of the vectors that one task holds: 16384 vectors of 64
ASKED_NUMBERS = 1 << 18  # numbers of the queries that meet them at once
MAX_CELLS = 1024
LEAF_ROWS = 32


def chi_square_quantile(probability: float, degrees: int) -> float:
    """Value that a chi-square variable of an even number of degrees does not exceed with the given probability."""

    def below(x: float) -> float:
        term = total = 1.0
        for i in range(1, degrees // 2):
            term *= x / 2 / i
            total += term
        return 1 - math.exp(-x / 2) * total

    low, high = 0.0, 1.0
    while below(high) < probability:
        high *= 2
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < probability else (low, middle)
    return high


@dataclass(frozen=True)
class Projection:
    """Maps vectors and queries of one length to few numbers."""

    matrix: np.ndarray
    longest: float

    @classmethod
    def of(cls, dim: int, longest: float, seed: int = SEED) -> Projection:
        return cls(np.random.default_rng([seed, dim]).standard_normal((dim + 1, PROJECTED)), longest)

    def vectors(self, rows: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.longest**2 - (rows * rows).sum(axis=1), 0.0))
        return rows @ self.matrix[:-1] + rest[:, None] * self.matrix[-1]

    def queries(self, rows: np.ndarray) -> np.ndarray:
        return (rows * self.scale(rows)[:, None]) @ self.matrix[:-1]

    def scale(self, rows: np.ndarray) -> np.ndarray:
        return self.longest / np.sqrt((rows * rows).sum(axis=1))

    def distance(self, score: float, scale: float) -> float:
        """Squared distance of a scaled query to a vector with this product."""
        return max(0.0, 2 * self.longest**2 - 2 * scale * score)


def halves(points: np.ndarray, rows: np.ndarray) -> tuple[int, np.ndarray]:
    """The widest dimension of some points, and the rows in its order."""
    own = points[rows]
    widest = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
    return widest, rows[np.argsort(own[:, widest], kind="stable")]


@dataclass(frozen=True)
class Cells:
    """A kd-tree over all of space: node i has the children 2i+1 and 2i+2; the last level are the cells."""

    dimension: np.ndarray
    value: np.ndarray
    low: np.ndarray  # corners of the cells
    high: np.ndarray

    @classmethod
    def cut(cls, sample: np.ndarray, depth: int) -> Cells:
        nodes = 2**depth - 1
        dimension, value = np.zeros(nodes, dtype=np.int64), np.zeros(nodes)
        low, high = np.full((2 * nodes + 1, PROJECTED), -np.inf), np.full((2 * nodes + 1, PROJECTED), np.inf)
        held = {0: np.arange(len(sample))}
        for node in range(nodes):
            rows = held.pop(node)
            if len(rows):
                d, rows = halves(sample, rows)
                dimension[node], value[node] = d, sample[rows[len(rows) // 2], d]
            d, v = dimension[node], value[node]
            left, right = 2 * node + 1, 2 * node + 2
            for child in (left, right):
                low[child], high[child] = low[node], high[node]
            high[left, d], low[right, d] = min(high[left, d], v), max(low[right, d], v)
            held[left], held[right] = rows[sample[rows, d] < v], rows[sample[rows, d] >= v]
        return cls(dimension, value, low[nodes:], high[nodes:])

    def of(self, points: np.ndarray) -> np.ndarray:
        """The cell of every point."""
        node = np.zeros(len(points), dtype=np.int64)
        for _ in range((len(self.value) + 1).bit_length() - 1):
            right = points[np.arange(len(points)), self.dimension[node]] >= self.value[node]
            node = 2 * node + 1 + right
        return node - len(self.value)

    def distances(self, point: np.ndarray) -> np.ndarray:
        """Least squared distance of a point to each cell."""
        return box_distances(point, self.low, self.high)


def box_distances(point: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    outside = np.maximum(np.maximum(low - point, point - high), 0.0)
    return (outside * outside).sum(axis=1)


class KdTree:
    """Leaves of a kd-tree over the vectors of one part, with the box of the projections in each."""

    def __init__(self, vectors: np.ndarray, projection: Projection):
        points = projection.vectors(vectors)
        leaves, open_rows = [], [np.arange(len(points))] if len(points) else []
        while open_rows:
            rows = open_rows.pop()
            if len(rows) <= LEAF_ROWS:
                leaves.append(rows)
                continue
            _, rows = halves(points, rows)
            half = (len(rows) // 2 + LEAF_ROWS - 1) // LEAF_ROWS * LEAF_ROWS  # all leaves but one are full
            open_rows += [rows[half:], rows[:half]]
        self.order = np.concatenate(leaves) if leaves else np.zeros(0, dtype=np.int64)
        self.vectors, self.points = vectors[self.order], points[self.order]
        sizes = np.array([len(x) for x in leaves], dtype=np.int64)
        self.stops = np.cumsum(sizes)
        self.starts = self.stops - sizes
        self.low = np.array([points[x].min(axis=0) for x in leaves]).reshape(-1, PROJECTED)
        self.high = np.array([points[x].max(axis=0) for x in leaves]).reshape(-1, PROJECTED)

    def best(self, query: np.ndarray, projected: np.ndarray, near: Callable[[float], float], k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of the best vectors, ties at the k-th included; none that is below the floor.

        Leaves are opened in the order of their boxes, and in them the vectors within the radius are verified. ``near``
        gives the radius (squared) that the test leaves for a k-th best score.
        """
        distance = box_distances(projected, self.low, self.high)
        order = np.argsort(distance, kind="stable")
        rows, scores = np.zeros(0, dtype=np.int64), np.zeros(0)
        at, step = 0, 2
        while at < len(order):
            radius = near(floor)
            if distance[order[at]] > radius:  # no later leaf passes the stopping test either
                break
            opened = order[at : at + step]
            opened = opened[distance[opened] <= radius]
            at, step = at + step, 2 * step
            places = np.concatenate([np.arange(a, b) for a, b in zip(self.starts[opened], self.stops[opened])])
            away = self.points[places] - projected
            places = places[(away * away).sum(axis=1) <= radius]
            found = self.vectors[places] @ query
            good = found >= floor - 1e-9 * abs(floor)
            rows, scores = np.concatenate([rows, places[good]]), np.concatenate([scores, found[good]])
            if len(scores) > k:
                kth = np.partition(scores, len(scores) - k)[len(scores) - k]
                kept = scores >= kth - 1e-9 * abs(kth)  # products are added up in another order below
                rows, scores, floor = rows[kept], scores[kept], max(floor, kth)
            elif len(scores) == k:
                floor = max(floor, scores.min())
        exact = (self.vectors[rows] * query).sum(axis=1)  # one order of additions for every vector, so that ties are ties
        return self.order[rows], exact


def matrix_of(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


# --- classes of equal vectors --------------------------------------------------------------------------------------


def usable(table: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v, class) of the rows that take part; equal vectors share the class, a digest."""
    rows = table.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull()).filter(finite & F.exists("v", lambda x: x != 0))

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = [
                hashlib.blake2b((v.values.to_numpy(zero_copy_only=False) + 0.0).tobytes(), digest_size=16).digest()  # -0.0 is 0.0
                for v in batch.column(1)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(digests, pa.binary())], names=["id", "v", "class"]
            )

    return rows.mapInArrow(classed, "id bigint, v array<double>, class binary")


def classes_of(rows: DataFrame, smallest: int) -> DataFrame:
    """(class, v, ids): every different vector with its smallest ids. A hot class sends a few rows from each task."""
    single = rows.groupBy("class", "id").agg(F.first("v").alias("v"))
    order = Window.partitionBy("class").orderBy("id")
    few = single.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= smallest)
    return few.groupBy("class").agg(F.first("v").alias("v"), F.sort_array(F.collect_list("id")).alias("ids"))


# --- search --------------------------------------------------------------------------------------------------------

FOUND = "class binary, id bigint, score double"


@dataclass(frozen=True)
class Index:
    """Classes of one vector length, each in its cell."""

    points: DataFrame  # cell, class, v, ids
    parts: dict[int, int]
    projection: Projection
    cells: Cells
    dim: int
    k: int

    @classmethod
    def build(cls, classes: DataFrame, dim: int, k: int) -> Index:
        squares = F.aggregate("v", F.lit(0.0), lambda total, x: total + x * x)
        rows, longest = classes.agg(F.count("*"), F.max(squares)).first()
        projection = Projection.of(dim, math.sqrt(longest))
        per_part = max(LEAF_ROWS, PART_NUMBERS // dim)
        depth = min(MAX_CELLS, -(-rows // per_part)) - 1
        sample = classes.orderBy("class").select("v").limit(max(2 * MAX_CELLS, SAMPLE_NUMBERS // dim)).toArrow()
        cells = Cells.cut(projection.vectors(matrix_of(sample["v"], dim)), depth.bit_length())

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = cells.of(projection.vectors(matrix_of(batch.column(1), dim)))
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), *batch.columns], names=["cell", "class", "v", "ids"])

        placed = classes.select("class", "v", "ids").mapInArrow(place, "cell int, class binary, v array<double>, ids array<bigint>")
        points = stored(placed, "neighbour-points")
        counts = points.groupBy("cell").count().collect()  # MAX_CELLS rows at most
        return cls(points, {r["cell"]: -(-r["count"] // per_part) for r in counts}, projection, cells, dim, k)

    def meet(self, visits: DataFrame) -> DataFrame:
        """(class, id, score): for every visit (cell, class, v, floor) the best of that cell. The groups that meet are
        bounded on both sides: cells are dealt to parts, the visits of a cell to slices."""
        spark, per_slice = self.points.sparkSession, max(64, ASKED_NUMBERS // self.dim)
        visitors = {r["cell"]: r["count"] for r in visits.groupBy("cell").count().collect()}
        sizes = [(c, self.parts[c], -(-n // per_slice)) for c, n in visitors.items() if c in self.parts]
        layout = F.broadcast(spark.createDataFrame(sizes, "cell int, parts int, slices int"))  # MAX_CELLS rows at most
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        own = lambda n: F.pmod(F.xxhash64("class"), F.col(n)).cast("int")
        points = self.points.join(layout, "cell").withColumn("part", own("parts")).withColumn("slice", every("slices"))
        asked = visits.join(layout, "cell").withColumn("slice", own("slices")).withColumn("part", every("parts"))
        projection, dim, k, degrees = self.projection, self.dim, self.k + 1, chi_square_quantile(CONFIDENCE, PROJECTED)

        def search(held: pa.Table, wanted: pa.Table) -> pa.Table:
            tree = KdTree(matrix_of(held["v"], dim), projection)
            queries = matrix_of(wanted["v"], dim)
            projected, scales = projection.queries(queries), projection.scale(queries)
            ids = held["ids"].to_pylist()
            out: tuple[list, list, list] = ([], [], [])
            for i, (name, floor) in enumerate(zip(wanted["class"].to_pylist(), wanted["floor"].to_pylist(), strict=True)):
                near = lambda kth, s=scales[i]: np.inf if kth == -np.inf else degrees * projection.distance(kth, s)
                rows, scores = tree.best(queries[i], projected[i], near, k, floor)
                pairs = sorted((-s, x) for r, s in zip(rows.tolist(), scores.tolist(), strict=True) for x in ids[r])[:k]
                out[0].extend([name] * len(pairs))
                out[1].extend(x for _, x in pairs)
                out[2].extend(-s for s, _ in pairs)
            return pa.table([pa.array(o, t) for o, t in zip(out, (pa.binary(), pa.int64(), pa.float64()), strict=True)], names=["class", "id", "score"])

        group = ("cell", "part", "slice")
        return (
            points.select(*group, "v", "ids").groupBy(*group)
            .cogroup(asked.select(*group, "class", "v", "floor").groupBy(*group))
            .applyInArrow(search, FOUND)
        )

    def others(self, asked: DataFrame) -> DataFrame:
        """(cell, class, v, floor): the cells beside a query's own that its stopping test does not leave out."""
        projection, cells, dim, degrees = self.projection, self.cells, self.dim, chi_square_quantile(CONFIDENCE, PROJECTED)

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                queries = matrix_of(batch.column(2), dim)
                projected, scales = projection.queries(queries), projection.scale(queries)
                visits, rows = [], []
                for i, (home, floor) in enumerate(zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                    radius = np.inf if floor == -np.inf else degrees * projection.distance(floor, scales[i])
                    near = np.flatnonzero(cells.distances(projected[i]) <= radius)
                    near = near[near != home]
                    visits.append(near)
                    rows.append(np.full(len(near), i))
                rows = pa.array(np.concatenate(rows) if rows else [], pa.int64())
                cell = pa.array(np.concatenate(visits) if visits else [], pa.int32())
                yield pa.RecordBatch.from_arrays([cell, *(batch.column(c).take(rows) for c in (1, 2, 3))], names=["cell", "class", "v", "floor"])

        return asked.select("cell", "class", "v", "floor").mapInArrow(route, "cell int, class binary, v array<double>, floor double")

    def search(self, wanted: DataFrame) -> DataFrame:
        """(class, id, score): for every wanted class the k + 1 best rows, so that k stay without a query's own."""
        asked = stored(self.points.join(wanted, "class", "left_semi").select("cell", "class", "v"), "neighbour-queries")
        first = stored(best_of(self.meet(asked.withColumn("floor", F.lit(float("-inf")))), self.k + 1), "neighbour-first")
        floors = first.groupBy("class").agg(F.when(F.count("*") > self.k, F.min("score")).alias("floor"))
        known = asked.join(floors, "class", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
        visits = stored(self.others(known), "neighbour-visits")
        return best_of(first.unionByName(self.meet(visits)), self.k + 1)


def best_of(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("class").orderBy(F.col("score").desc(), "id")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).drop("place")


def nearest(table: DataFrame, every: int = 20, k: int = TOP, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for every row whose id is divisible by ``every`` the ``k`` found nearest others.

    Scores are products in doubles; equal ones are in the order of ids. Null, zero and not finite vectors and rows
    without id take no part. Vectors meet those of their own length. Of rows with equal id and vector one counts; a query
    never finds rows of its own id, and an id with two vectors asks twice. Other columns are not read. An empty table gives an empty result, fewer than ``k`` candidates give all.
    """
    spark = table.sparkSession
    rows = usable(table, key, vector)
    classes = stored(classes_of(rows, k + 1), "neighbour-classes")
    queries = rows.filter(F.pmod("id", F.lit(every)) == 0).select("class", F.col("id").alias("query_id")).distinct()
    wanted = queries.select("class").distinct()
    dims = [r[0] for r in classes.groupBy(F.size("v")).count().collect()]
    found = [Index.build(classes.filter(F.size("v") == dim), dim, k).search(wanted) for dim in sorted(dims)]
    best = reduce(DataFrame.unionByName, found) if found else no_rows(spark)
    lists = best.groupBy("class").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))).alias("best"))
    others = F.slice(F.filter("best", lambda b: b["id"] != F.col("query_id")), 1, k)
    listed = queries.join(lists, "class").select("query_id", F.posexplode(others).alias("place", "hit"))
    return listed.select(
        "query_id", (F.col("place") + 1).alias("rank"), F.col("hit.id").alias("vec_id"), (-F.col("hit.s")).alias("score")
    )


def no_rows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], FOUND)
