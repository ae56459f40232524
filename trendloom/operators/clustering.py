"""K-Means, centroids and memberships."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import vectors
from .similarity import SmallVectors, assign_to

SEED_ROWS = 16_384  # rows that the seeds of the starts are drawn from
SUMS_AT_ONCE = 16_000_000  # numbers that the sums of all partitions of a round may have
ROWS_AT_ONCE = 2048  # vectors whose distances to all centres are held at once in a task


def dynamic_k(tickets: int) -> int | None:
    """One cluster per 12 tickets, at least 7 and at most 20; None when there are too few tickets to cluster."""
    if tickets < V.CLUSTER_MIN:
        return None
    return max(V.CLUSTER_MIN, min(V.CLUSTER_MAX, tickets // V.TICKETS_PER_CLUSTER))


def usable_tickets(tickets: DataFrame, vector: str = "embedding") -> DataFrame:
    return tickets.filter(vectors.usable(F.col(vector)))


def cluster_centroids(rows: DataFrame, cluster: str = "cluster_id", vector: str = "embedding") -> DataFrame:
    """(cluster, centroid, members): the mean vector of every cluster, summed up before the shuffle."""
    dense = rows.select(cluster, array_to_vector(vectors.as_doubles(F.col(vector))).alias("v"))
    return dense.groupBy(cluster).agg(
        vector_to_array(Summarizer.mean(F.col("v"))).alias("centroid"), F.count("*").alias("members")
    )


@dataclass(frozen=True)
class Clustering:
    """Final centroids (k rows) and the input rows with their cluster and score."""

    centroids: SmallVectors
    rows: DataFrame
    rounds: int
    fit: float  # higher is better, among runs on the same rows


def kmeans(
    rows: DataFrame, k: int, measure: str = "cosine", seed: int = V.KMEANS_SEED, starts: int | None = None,
    max_iter: int | None = None, vector: str = "embedding",
) -> Clustering:
    """K-Means of the usable vectors, the best of several seeded starts. Clusters are numbered from 0.

    Starts and rounds that are not given are those of the original: 10 and at most 300 for ``euclidean``, 1 and at most
    20 for ``cosine``.
    ``euclidean`` is K-Means of the vectors on unit length; centroids are means of unit vectors. All starts advance in
    the same scans; their seeds are drawn by k-means++ from at most ``SEED_ROWS`` rows, the rounds use all.
    ``cosine`` assigns by cosine, centroids are means of the vectors as they are; it starts from seeds that are spread
    in the same way and then takes one uncached scan per round.
    """
    default_starts, default_rounds = V.KMEANS_RUNS[measure]
    starts = default_starts if starts is None else starts
    max_iter = default_rounds if max_iter is None else max_iter
    if measure == "euclidean":
        return _best_of_starts(rows, k, seed, starts, max_iter, vector)
    dense = rows.select(array_to_vector(vectors.as_doubles(F.col(vector))).alias("_raw"))
    unit = Normalizer(inputCol="_raw", outputCol="_v").transform(dense).select("_v")
    unit = unit.persist(StorageLevel.MEMORY_AND_DISK)
    try:  # without rounds the fit is only the spread of the seeds
        models = [KMeans(k=k, seed=seed + i, maxIter=0, featuresCol="_v").fit(unit) for i in range(starts)]
    finally:
        unit.unpersist()
    return max((lloyd(rows, _numbered(np.array(m.clusterCenters())), max_iter, vector) for m in models), key=lambda c: c.fit)


def _numbered(centers: np.ndarray) -> SmallVectors:
    return SmallVectors([f"{i:04d}" for i in range(len(centers))], centers)


# --- several starts in one scan ------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Starts:
    """K-Means from several starts: final centres (start, cluster, dimension), and members, cost and rounds of them."""

    centres: np.ndarray
    members: np.ndarray
    costs: np.ndarray
    rounds: np.ndarray


def _best_of_starts(rows: DataFrame, k: int, seed: int, starts: int, max_iter: int, vector: str) -> Clustering:
    values = rows.select(vector).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        sample = values.filter(vectors.usable(F.col(vector))).withColumn("dim", F.size(vector))
        dim = sample.groupBy("dim").count().orderBy(F.col("count").desc(), "dim").first()
        if dim is None:
            return Clustering(_numbered(np.zeros((0, 1))), assign_to(rows, SmallVectors([], np.zeros((0, 1))), vector), 0, 0.0)
        drawn = sample.filter(F.col("dim") == dim["dim"]).orderBy(F.xxhash64(vector)).limit(SEED_ROWS).select(vectors.as_doubles(F.col(vector)).alias("v"))
        units = vectors.unit_rows(np.stack(drawn.toPandas()["v"].to_list()))
        units = units[np.isfinite(units).all(axis=1)]
        seeds = np.stack([spread_seeds(units, k, np.random.default_rng([seed, i])) for i in range(starts)])
        found = lloyd_starts(values, seeds, max_iter, vector)
    finally:
        values.unpersist()
    best = int(found.costs.sum(axis=1).argmin())
    centers = _numbered(found.centres[best])
    return Clustering(centers, assign_to(rows, centers, vector, "euclidean"), int(found.rounds[best]), -float(found.costs[best].sum()))


def spread_seeds(units: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++: each seed is drawn by its squared distance to those before it, the best of a few draws."""
    draws = 2 + int(np.log(k))
    seeds = [units[rng.integers(len(units))]]
    distance = ((units - seeds[0]) ** 2).sum(axis=1)
    while len(seeds) < k:
        total = np.cumsum(distance)
        tried = np.minimum(np.searchsorted(total, rng.random(draws) * total[-1], side="right"), len(units) - 1)
        left = np.minimum(distance, np.maximum(2 - 2 * units[tried] @ units.T, 0.0))
        best = int(left.sum(axis=1).argmin())
        seeds.append(units[tried[best]])
        distance = left[best]
    return np.array(seeds)


def lloyd_starts(
    rows: DataFrame, centres: np.ndarray, max_iter: int, vector: str = "embedding", tolerance: float = 1e-4
) -> Starts:
    """K-Means of the vectors on unit length from several sets of centres at once.

    The vectors are put on unit length once and kept in as many partitions as cores. A round is one stage for all starts:
    every batch meets the centres of all of them in one matrix product, and the driver adds up one set of sums a partition,
    so a round costs no shuffle. A start
    whose centres move no more than the tolerance leaves, so there are as many scans as the slowest start has rounds, and one
    that measures the final centres. An empty cluster stays where it is.
    """
    centres = centres.copy()
    rounds = np.zeros(len(centres), dtype=np.int64)
    active = np.arange(len(centres))
    parts = min(rows.sparkSession.sparkContext.defaultParallelism, SUMS_AT_ONCE // centres.size)
    units = unit_vectors(rows, centres.shape[2], vector).coalesce(max(1, parts)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for _ in range(max_iter):
            if not len(active):
                break
            totals, members, _ = _starts_round(units, centres[active], "unit")
            moved = np.where(members[..., None] > 0, totals / np.maximum(members, 1)[..., None], centres[active])
            shift = np.sqrt(((moved - centres[active]) ** 2).sum(axis=2)).max(axis=1)
            centres[active] = moved
            rounds[active] += 1
            active = active[shift > tolerance]
        _, members, costs = _starts_round(units, centres, "unit")
    finally:
        units.unpersist()
    return Starts(centres, members, costs, rounds)


def unit_vectors(rows: DataFrame, dim: int, vector: str) -> DataFrame:
    """(unit): the finite vectors of one length on unit length, so that no round has to convert them again."""

    def on_unit_length(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = vectors.unit_rows(vectors.batch_matrix(batch.column(0), dim)[1])
            offsets = pa.array(np.arange(0, unit.size + 1, dim), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(unit.ravel()))], names=["unit"])

    return rows.select(vector).mapInArrow(on_unit_length, "unit array<double>")


def _starts_round(rows: DataFrame, centres: np.ndarray, vector: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums, numbers and squared distances of the members of each cluster of each start; the vectors have unit length."""
    starts, k, dim = centres.shape
    flat = centres.reshape(-1, dim)
    half = (flat**2).sum(axis=1)[:, None] / 2
    first = np.arange(starts)[:, None] * k  # row of the first cluster of each start

    def sums_of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, members, costs = np.zeros(flat.shape), np.zeros(starts * k, dtype=np.int64), np.zeros(starts * k)
        for batch in batches:
            units = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            for start in range(0, len(units), ROWS_AT_ONCE):
                unit = units[start : start + ROWS_AT_ONCE]
                # |x - c|^2 = |x|^2 - 2 (x.c - |c|^2 / 2); one row a centre, so that each step below runs along the vectors
                table = np.round(flat @ unit.T - half, vectors.SCORE_DIGITS).reshape(starts, k, -1)
                best, label = table[:, 0].copy(), np.zeros((starts, len(unit)), dtype=np.int64)
                for cluster in range(1, k):
                    np.copyto(label, cluster, where=table[:, cluster] > best)
                    np.maximum(best, table[:, cluster], out=best)
                label += first
                members += np.bincount(label.ravel(), minlength=starts * k)
                costs += np.bincount(label.ravel(), ((unit**2).sum(axis=1) - 2 * best).ravel(), starts * k)
                own = np.zeros((starts * k, len(unit)))
                own[label, np.arange(len(unit))] = 1.0
                totals += own @ unit
        seen = np.flatnonzero(members)
        kinds = [("row", pa.int32()), ("members", pa.int64()), ("cost", pa.float64()), ("total", pa.list_(pa.float64()))]
        values = (seen, members[seen], costs[seen], list(totals[seen]))
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, (_, t) in zip(values, kinds)], schema=pa.schema(kinds))

    partial = rows.select(vector).mapInArrow(sums_of_partition, "row int, members bigint, cost double, total array<double>")
    found = partial.toArrow()  # for every partition at most one row per start and cluster
    at = found["row"].to_numpy()
    totals, members, costs = np.zeros((starts * k, dim)), np.zeros(starts * k, dtype=np.int64), np.zeros(starts * k)
    np.add.at(members, at, found["members"].to_numpy())
    np.add.at(costs, at, found["cost"].to_numpy())
    np.add.at(totals, at, found["total"].combine_chunks().flatten().to_numpy().reshape(-1, dim))
    return totals.reshape(centres.shape), members.reshape(starts, k), costs.reshape(starts, k)


# --- cosine rounds -------------------------------------------------------------------------------------------------


def lloyd(
    rows: DataFrame, start: SmallVectors, max_iter: int = V.KMEANS_MAX_ITER, vector: str = "embedding"
) -> Clustering:
    """Cosine K-Means from given centroids: assign, then take the mean of the members; an empty cluster stays put.

    A round is one scan. Every task adds up its own rows per cluster and only those sums are shuffled; the centroids
    return to the driver as k rows, so no lineage grows from round to round. Stops when no centroid moves.
    """
    current, fit = start, 0.0
    for round_number in range(max_iter):
        moved, fit = _one_round(rows, current, vector)
        if np.allclose(moved, current.matrix, rtol=0, atol=1e-12):
            return Clustering(current, assign_to(rows, current, vector), round_number, fit)
        current = SmallVectors(start.ids, moved)
    return Clustering(current, assign_to(rows, current, vector), max_iter, fit)


def _one_round(rows: DataFrame, current: SmallVectors, vector: str) -> tuple[np.ndarray, float]:
    """The moved centroids, and the sum of all scores under the old ones."""
    matrix = current.matrix

    def sums_of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, members, fit = np.zeros(matrix.shape), np.zeros(len(matrix), dtype=np.int64), np.zeros(len(matrix))
        for batch in batches:
            _, dense = vectors.batch_matrix(batch.column(0), matrix.shape[1])
            if len(dense):
                label, score = vectors.nearest(dense, matrix, "cosine")
                members += np.bincount(label, minlength=len(matrix))
                fit += np.bincount(label, score, len(matrix))
                totals += (np.arange(len(matrix))[:, None] == label[None, :]).astype(np.float64) @ dense
        seen = np.flatnonzero(members)
        kinds = [("row", pa.int32()), ("members", pa.int64()), ("fit", pa.float64()), ("total", pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(
            [pa.array(values, kind) for values, (_, kind) in zip((seen, members[seen], fit[seen], list(totals[seen])), kinds)],
            schema=pa.schema(kinds),
        )

    partial = rows.select(vector).mapInArrow(sums_of_partition, "row int, members bigint, fit double, total array<double>")
    summed = partial.groupBy("row").agg(
        F.sum("members").alias("members"), F.sum("fit").alias("fit"),
        vector_to_array(Summarizer.sum(array_to_vector("total"))).alias("total"),
    )
    moved, fit = matrix.copy(), 0.0
    for row in summed.collect():  # at most one row per centroid
        moved[row["row"]] = np.array(row["total"]) / row["members"]
        fit += row["fit"]
    return moved, fit


def membership(assigned: DataFrame, key: str = "id", score: str = "cosine") -> DataFrame:
    """Member rows of assigned tickets; ``score='const'`` stores 1.0 as a re-cluster does in the original."""
    value = F.lit(1.0) if score == "const" else vectors.shown_score(F.col("similarity_score"))
    return assigned.filter(F.col("cluster_id").isNotNull()).select(
        F.col(key).alias("ticket_id"), "cluster_id", value.alias("similarity_score")
    )


def best_assignment(gain: np.ndarray) -> list[int]:
    """For each row its column, each column at most once, with the largest total gain (Hungarian method).

    Rows enter one after another; each looks for the cheapest way to a free column over the columns that are taken, and
    prices on rows and columns keep all reduced costs at 0 or more.
    """
    rows, columns = gain.shape
    size = max(rows, columns)
    cost = np.zeros((size, size))
    cost[:rows, :columns] = -gain
    row_price, column_price = np.zeros(size), np.zeros(size)
    taken_by = np.full(size, -1)
    for row in range(size):
        least, before, done = np.full(size, np.inf), np.full(size, -1), np.zeros(size, dtype=bool)
        current, column = row, -1
        while True:
            reduced = cost[current] - row_price[current] - column_price
            better = ~done & (reduced < least)
            least[better], before[better] = reduced[better], column
            open_least = np.where(done, np.inf, least)
            column, step = int(open_least.argmin()), open_least.min()
            on_path = taken_by[done]
            row_price[on_path] += step
            row_price[row] += step
            column_price[done] -= step
            least[~done] -= step
            done[column] = True
            if taken_by[column] < 0:
                break
            current = taken_by[column]
        while column >= 0:
            previous = before[column]
            taken_by[column] = taken_by[previous] if previous >= 0 else row
            column = previous
    found = np.empty(size, dtype=int)
    found[taken_by] = np.arange(size)
    return found[:rows].tolist()


def keep_cluster_ids(new: SmallVectors, old: SmallVectors | None, threshold: float = 0.9) -> list[str]:
    """For each new centroid the id of the old one it continues, else its own id. Of all ways to pair centroids of at
    least the threshold, each once, it is the one with the largest total similarity."""
    if old is None or not old.ids or old.dim != new.dim:
        return list(new.ids)
    table = vectors.scores(new.matrix, vectors.unit_rows(old.matrix))
    gain = np.where(table >= threshold, table, 0.0)
    continues = {row: old.ids[column] for row, column in enumerate(best_assignment(gain)) if column < len(old.ids) and gain[row, column] > 0}
    out = [continues.get(row) for row in range(len(new.ids))]
    used = {*old.ids, *new.ids}
    for row, own in enumerate(new.ids):
        if out[row] is None:
            while own in old.ids or own in out:  # an id of a run that numbered its clusters alike
                own = f"{own}n"
                if own not in used:
                    break
            out[row] = own
            used.add(own)
    return out
