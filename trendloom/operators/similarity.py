"""Similarity search and nearest-centroid assignment.

The small side (centroids, query vectors) is measured before it is sent to the tasks. Within the bound one scan of the
large side is enough and nothing large is shuffled. Beyond it both sides are cut into cells, and only cells that can
hold a match meet (``vector_index``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import vectors
from .ranking import top_per_group

SMALL_SIDE_BYTES = 64 << 20  # largest matrix sent to every task
SMALL_SIDE_ROWS = 10_000
SCORES_AT_ONCE = 2_000_000  # cells of one score table in a task
HITS_AT_ONCE = 500_000  # matches that wait to be ranked in a task
BLOCK_CELLS = 2_000_000  # numbers in one group of vectors


@dataclass(frozen=True)
class SmallVectors:
    """Ids and vectors of a table that was found small enough for the driver and for every task."""

    ids: list
    matrix: np.ndarray

    @property
    def dim(self) -> int:
        return self.matrix.shape[1]


def small_vectors_by_size(rows: DataFrame, key: str, vector: str) -> list[SmallVectors] | None:
    """The usable vectors in key order, one table for each length, or None when all are over the bound."""
    present = rows.filter(F.col(key).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0))
    number, cells = present.agg(F.count("*"), F.sum(F.size(vector))).first()
    if number and (number > SMALL_SIDE_ROWS or cells * 8 > SMALL_SIDE_BYTES):
        return None
    sizes: dict[int, list] = {}
    for r in present.select(key, vectors.as_doubles(F.col(vector)).alias("v")).collect():
        sizes.setdefault(len(r[1]), []).append((r[0], r[1]))
    tables = []
    for dim, pairs in sorted(sizes.items()):
        pairs.sort()
        tables.append(SmallVectors([p[0] for p in pairs], np.array([p[1] for p in pairs], dtype=np.float64).reshape(-1, dim)))
    return tables


def small_vectors(rows: DataFrame, key: str, vector: str) -> SmallVectors | None:
    """The usable vectors of the commonest length (the longer one on ties), or None when all are over the bound."""
    tables = small_vectors_by_size(rows, key, vector)
    if tables is None:
        return None
    return max(tables, key=lambda t: (len(t.ids), t.dim), default=SmallVectors([], np.zeros((0, 1))))


# --- nearest centroid ---------------------------------------------------------------------------------------------


def assign_to(rows: DataFrame, centroids: SmallVectors, vector: str = "embedding", measure: str = "cosine") -> DataFrame:
    """Adds ``cluster_id`` and ``similarity_score`` of the best centroid (the lower id on ties); a narrow step."""
    best = rows.withColumn("_best", vectors.nearest_row(F.col(vector), centroids.matrix, measure))
    if not centroids.ids:
        return best.withColumns({"cluster_id": F.lit(None).cast("string"), "similarity_score": F.lit(None).cast("double")}).drop("_best")
    names = F.array(*[F.lit(i) for i in centroids.ids])
    return best.withColumns(
        {"cluster_id": F.get(names, F.col("_best.row")), "similarity_score": F.col("_best.score")}
    ).drop("_best")


def nearest_centroid(
    tickets: DataFrame, clusters: DataFrame, key: str = "id", vector: str = "embedding",
    cluster_id: str = "id", centroid: str = "centroid_embedding",
) -> DataFrame:
    """The tickets with the cluster of highest cosine and the score; NULLs where no centroid fits the vector.

    A vector meets the centroids of its own length, so that a misfit centroid concerns no other ticket.
    """
    tables = small_vectors_by_size(clusters, cluster_id, centroid)
    if tables is not None and len(tables) < 2:
        return assign_to(tickets, tables[0] if tables else SmallVectors([], np.zeros((0, 1))), vector)
    if tables is not None:
        best = [
            F.when(
                F.size(vector) == table.dim,
                F.struct(vectors.nearest_row(F.col(vector), table.matrix, "cosine").alias("best"), F.lit(i).alias("table")),
            )
            for i, table in enumerate(tables)
        ]
        names = F.array(*[F.array(*[F.lit(i) for i in table.ids]) for table in tables])
        found = tickets.withColumn("_found", F.coalesce(*best))
        return found.withColumns(
            {
                "cluster_id": F.get(F.get(names, F.col("_found.table")), F.col("_found.best.row")),
                "similarity_score": F.col("_found.best.score"),
            }
        ).drop("_found")
    from .vector_index import pruned_topk

    best = pruned_topk(clusters, tickets, 1, None, cluster_id, centroid, key, vector)
    found = best.select(F.col("query_id").alias(key), F.col("match_id").alias("cluster_id"), F.col("similarity").alias("similarity_score"))
    return tickets.join(found, key, "left")


# --- top-k similarity ---------------------------------------------------------------------------------------------


def find_similar(
    tickets: DataFrame, query: list[float], threshold: float = V.SIMILARITY_THRESHOLD, limit: int = V.SIMILARITY_LIMIT
) -> DataFrame:
    """The tickets most similar to one vector: above the threshold, best first, at most ``limit``."""
    one = SmallVectors([0], np.array([query], dtype=np.float64))
    best = _scan_topk(tickets, one, limit, threshold, "id", "embedding", "int")
    # The winners are at most `limit` rows: they go to the tickets, and only they carry the text columns.
    fields = ["id", "ticket_id", "subject", "description", "priority", "ticket_type", "product_area", "created_at"]
    winners = best.select(F.col("match_id").alias("id"), "similarity")
    joined = tickets.select(*fields).join(F.broadcast(winners), "id")
    return joined.orderBy(F.col("similarity").desc(), "id")


def search_arguments(threshold: float = V.SIMILARITY_THRESHOLD, limit: int = V.SIMILARITY_LIMIT) -> tuple[float, int]:
    """The threshold held in [0, 1], the limit at most 50."""
    return min(max(threshold, 0.0), 1.0), min(limit, V.SIMILARITY_LIMIT_MAX)


def similar_topk(
    corpus: DataFrame, queries: DataFrame, k: int = V.SIMILARITY_LIMIT, threshold: float | None = V.SIMILARITY_THRESHOLD,
    corpus_id: str = "id", corpus_vector: str = "embedding", query_id: str = "query_id", query_vector: str = "embedding",
) -> DataFrame:
    """(query_id, match_id, similarity, rank): for every query the ``k`` best above the threshold, ties by id."""
    tables = small_vectors_by_size(queries, query_id, query_vector)
    if tables is None:
        from .vector_index import pruned_topk

        return pruned_topk(corpus, queries, k, threshold, corpus_id, corpus_vector, query_id, query_vector)
    kind = queries.schema[query_id].dataType.simpleString()
    tables = tables or [SmallVectors([], np.zeros((0, 1)))]
    return reduce(
        DataFrame.unionByName, [_scan_topk(corpus, t, k, threshold, corpus_id, corpus_vector, kind) for t in tables]
    )


def _scan_topk(corpus, queries: SmallVectors, k, threshold, corpus_id, corpus_vector, query_type) -> DataFrame:
    unit, dim, ids = vectors.unit_rows(queries.matrix), queries.dim, queries.ids
    match_type = corpus.schema[corpus_id].dataType.simpleString()

    def best_of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(unit, k, threshold)
        for batch in batches:
            positions, rows = vectors.batch_matrix(batch.column(1), dim)
            best.add(batch.column(0).take(pa.array(positions)).to_numpy(zero_copy_only=False), rows)
        found = best.rows()
        yield pa.RecordBatch.from_pydict(
            {
                "query_id": [ids[q] for q in found["query"]],
                "match_id": found["match"].tolist(),
                "similarity": found["score"].to_numpy(dtype=np.float64),
            },
            schema=pa.schema([("query_id", _arrow(query_type)), ("match_id", _arrow(match_type)), ("similarity", pa.float64())]),
        )

    if not ids:
        return corpus.sparkSession.createDataFrame([], f"query_id {query_type}, match_id {match_type}, similarity double, rank int")
    narrow = corpus.select(corpus_id, corpus_vector).filter(F.col(corpus_vector).isNotNull())
    partial = narrow.mapInArrow(best_of_partition, f"query_id {query_type}, match_id {match_type}, similarity double")
    return _overall(partial, k)


def _overall(partial: DataFrame, k: int) -> DataFrame:
    return top_per_group(partial, ["query_id"], [F.col("similarity").desc(), F.col("match_id")], k)


def _arrow(sql_type: str) -> pa.DataType:
    return {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[sql_type]


class _Best:
    """The k best matches per query seen so far in a task; ``floor`` is what a match of each query must reach."""

    def __init__(self, unit_queries: np.ndarray, k: int, threshold: float | None, floor: np.ndarray | None = None):
        self.unit, self.k = unit_queries, k
        self.above = -np.inf if threshold is None else threshold
        self.floor = np.full(len(unit_queries), -np.inf) if floor is None else floor.copy()
        self.kept = pd.DataFrame({"query": np.array([], dtype=np.int64), "match": [], "score": np.array([], dtype=float)})
        self.waiting: list[pd.DataFrame] = []

    def add(self, match_ids: np.ndarray, rows: np.ndarray, asking: np.ndarray | None = None) -> None:
        """``asking`` are the positions of the queries that meet the rows; all, if not given."""
        units = self.unit if asking is None else self.unit[asking]
        step = max(1, SCORES_AT_ONCE // max(1, len(units)))
        rows = vectors.unit_rows(rows)
        for start in range(0, len(rows), step):
            floor = self.floor if asking is None else self.floor[asking]
            table = rows[start : start + step] @ units.T
            least = np.maximum(floor, self.above) - vectors.SCORE_SLACK
            hit = table >= least
            if len(table) > self.k and np.count_nonzero(hit) > self.k * len(units):  # the k best of these rows, and ties
                hit &= table >= np.partition(table, -self.k, axis=0)[-self.k] - vectors.SCORE_SLACK
            row, query = np.nonzero(hit)
            score = np.round(table[row, query], vectors.SCORE_DIGITS)
            exact = (score > self.above) & (score >= floor[query])
            row, query, score = row[exact], query[exact], score[exact]
            if len(row):
                query = query if asking is None else asking[query]
                self.waiting.append(pd.DataFrame({"query": query, "match": match_ids[start + row], "score": score}))
                if sum(map(len, self.waiting)) > HITS_AT_ONCE:
                    self._keep()

    def _keep(self) -> None:
        rows, self.waiting = [r for r in (self.kept, *self.waiting) if len(r)], []
        if not rows:
            return
        ordered = pd.concat(rows).sort_values(["query", "score", "match"], ascending=[True, False, True])
        self.kept = ordered[ordered.groupby("query").cumcount() < self.k]
        full = self.kept.groupby("query")["score"].agg(["size", "min"])
        full = full[full["size"] == self.k]
        self.floor[full.index.to_numpy()] = full["min"].to_numpy()

    def rows(self) -> pd.DataFrame:
        self._keep()
        return self.kept


def member_scores(members: DataFrame, clusters: DataFrame, vector: str = "embedding") -> DataFrame:
    """Members (with ``cluster_id`` and vector) with the cosine to the centroid of their own cluster."""
    own = clusters.select(F.col("id").alias("cluster_id"), F.col("centroid_embedding").alias("_own"))
    score = vectors.cosine(F.col(vector), F.col("_own"))
    return members.join(own, "cluster_id").withColumn("similarity_score", score).drop("_own")
