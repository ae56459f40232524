"""Ranked lexical search: the best documents of every query text, by pruned search over impact vectors.

A document is a vector of integer impacts over the terms of the queries. In every task the vectors are put in order of
their length and cut into buckets. With the k-th best score of a query so far as its threshold,

* a bucket is left out when its longest vector times the query's length stays below the threshold (Cauchy-Schwarz);
  all later buckets of the batch are shorter, so they are left out with it;
* inside a bucket the query's strongest terms are added up first. What the other terms can still give a document is
  bounded by the largest impact of each of them in the bucket, and by Cauchy-Schwarz on the rest of the vector;
* the documents that can still reach the threshold are scored again exactly, in 64-bit integers.

Every task has its own ladder of buckets, so the pruned work is spread evenly, no vector is shuffled, and only the k
best rows of each task and query meet.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from trendloom.llm.common import stored

TOP = 10
QUERY_BYTES = 8 << 20  # text of the queries that are sent to every task at once; more of them take further passes
BUCKET_ROWS = 1024
FOCUS_TERMS = 8
SEED_ROWS = 4096  # about so many documents with most query terms give the first thresholds

# Letters of terms: all but the ASCII ones that are neither digit nor letter. A-Z are lower-cased, nothing else is.
TERM_LETTERS = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256)
)
NO_ID = np.iinfo(np.int64).max  # stands for a null id, which comes last among equal scores


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TERM_LETTERS).split()


@dataclass(frozen=True)
class Queries:
    """Query vectors of one pass. ``vocabulary`` numbers their terms; a query is (terms, counts)."""

    ids: list
    vocabulary: dict[bytes, int]
    vectors: list[tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, rows: list[Row]) -> Queries:
        vocabulary: dict[bytes, int] = {}
        vectors = []
        for _, text in rows:
            counts = Counter(terms_of((text or "").encode()))
            numbers = [vocabulary.setdefault(t, len(vocabulary)) for t in counts]
            vectors.append((np.array(numbers, dtype=np.int64), np.array(list(counts.values()), dtype=np.int64)))
        return cls([r[0] for r in rows], vocabulary, vectors)


# --- postings -----------------------------------------------------------------------------------------------------


def postings(docs: DataFrame, vocabulary: dict[bytes, int], text: str, key: str) -> DataFrame:
    """(key, n, terms, tfs) of every document with a term: all its terms counted, those of the queries listed."""
    known = vocabulary.get

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, ends, numbers, counts = [], [], [0], [], []
            for row, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = terms_of(body)
                if not words:
                    continue
                found = [(t, c) for w, c in Counter(words).items() if (t := known(w)) is not None]
                numbers += [t for t, _ in found]
                counts += [c for _, c in found]
                ids.append(row)
                sizes.append(len(words))
                ends.append(len(numbers))
            place = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()),
                    pa.ListArray.from_arrays(place, pa.array(numbers, pa.int32())),
                    pa.ListArray.from_arrays(place, pa.array(counts, pa.int32())),
                ],
                names=["key", "n", "terms", "tfs"],
            )

    narrow = docs.select(F.col(f"`{key}`").cast("bigint").alias("key"), F.col(f"`{text}`").cast("binary").alias("text"))
    return narrow.filter(F.col("text").isNotNull()).mapInArrow(count, "key bigint, n bigint, terms array<int>, tfs array<int>")


@dataclass(frozen=True)
class Corpus:
    """Figures over all documents with a term, and the weight of every query term."""

    documents: int
    terms: int
    weights: np.ndarray

    @classmethod
    def of(cls, counted: DataFrame, size: int) -> Corpus:
        documents, terms = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        frequency = np.zeros(size, dtype=np.int64)
        for term, df in counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # one row per query term
            frequency[term] = df
        weights = [math.floor(1000 * math.log((2 * documents + 2) / (2 * int(df) + 1))) for df in frequency]
        return cls(documents, terms, np.array(weights, dtype=np.int64))

    def impacts(self, n: np.ndarray, terms: np.ndarray, tfs: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Impact of every posting; ``sizes`` says how many belong to each document."""
        m = np.repeat(25 + 75 * n * self.documents // self.terms, sizes)
        return self.weights[terms] * (1_000_000_000 * tfs // (1000 * tfs + 8 * m))


# --- search in one task -------------------------------------------------------------------------------------------


class Bucket:
    """Vectors of about one length: by document, and by term for the terms of the queries."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, sizes: np.ndarray, terms: np.ndarray, impacts: np.ndarray, size: int):
        self.ids, self.lengths, self.sizes, self.terms, self.impacts = ids, lengths, sizes, terms, impacts
        self.starts = np.cumsum(sizes) - sizes
        order = np.argsort(terms, kind="stable")
        self.column_docs = np.repeat(np.arange(len(ids)), sizes)[order]
        self.column_impacts = impacts[order]
        self.edges = np.searchsorted(terms[order], np.arange(size + 1))
        self.largest = np.zeros(size, dtype=np.int64)
        held = np.flatnonzero(np.diff(self.edges))
        if len(held):
            self.largest[held] = np.maximum.reduceat(self.column_impacts, self.edges[held])

    def survivors(self, terms: np.ndarray, counts: np.ndarray, threshold: int) -> np.ndarray:
        """Documents whose score can reach the threshold by what the strongest terms give and the others could."""
        most = counts * self.largest[terms]
        order = np.argsort(-most, kind="stable")
        focus, rest = order[:FOCUS_TERMS], order[FOCUS_TERMS:]
        if most.sum() < threshold:
            return np.zeros(0, dtype=np.int64)
        gained = np.zeros(len(self.ids))
        seen = np.zeros(len(self.ids))
        for i in focus:
            a, b = self.edges[terms[i]], self.edges[terms[i] + 1]
            docs, impacts = self.column_docs[a:b], self.column_impacts[a:b].astype(np.float64)
            gained[docs] += counts[i] * impacts
            seen[docs] += impacts * impacts
        left = np.sqrt(np.maximum(self.lengths**2 - seen, 0.0)) * math.sqrt(float((counts[rest] ** 2).sum()))
        bound = gained + np.minimum(left, float(most[rest].sum()))
        return np.flatnonzero(bound * (1 + 1e-9) >= threshold)  # the margin covers rounding of the bounds

    def scores(self, docs: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Exact scores of some documents; ``weights`` has the query's count of every term."""
        sizes = self.sizes[docs]
        kept = docs[sizes > 0]
        out = np.zeros(len(docs), dtype=np.int64)
        if len(kept):
            inner = np.repeat(self.starts[kept] - (np.cumsum(self.sizes[kept]) - self.sizes[kept]), self.sizes[kept])
            at = inner + np.arange(len(inner))
            first = np.cumsum(self.sizes[kept]) - self.sizes[kept]
            out[sizes > 0] = np.add.reduceat(weights[self.terms[at]] * self.impacts[at], first)
        return out


class Search:
    """The best documents of every query among those that were added."""

    def __init__(self, queries: Queries, corpus: Corpus, k: int, floors: np.ndarray | None = None):
        self.queries, self.corpus, self.k = queries, corpus, k
        self.floors = np.ones(len(queries.ids), dtype=np.int64) if floors is None else floors
        self.lengths = np.array([math.sqrt(float((c**2).sum())) for _, c in queries.vectors])
        self.scores = [np.zeros(0, dtype=np.int64) for _ in queries.ids]
        self.found = [np.zeros(0, dtype=np.int64) for _ in queries.ids]
        self.weights = np.zeros(len(queries.vocabulary), dtype=np.int64)
        self.buckets_met = self.rescored = 0

    def add(self, ids: np.ndarray, n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray) -> None:
        """Searches a batch of documents, longest vectors first."""
        impacts = self.corpus.impacts(n, terms, tfs, sizes)
        owner = np.repeat(np.arange(len(ids)), sizes)
        lengths = np.sqrt(np.bincount(owner, impacts.astype(np.float64) ** 2, len(ids)))
        starts = np.cumsum(sizes) - sizes
        order = np.argsort(-lengths, kind="stable")
        for at in range(0, len(order), BUCKET_ROWS):
            docs = order[at : at + BUCKET_ROWS]
            live = np.flatnonzero(self.lengths * (lengths[docs[0]] * (1 + 1e-9)) >= self.floors)
            if not len(live):
                return
            own = np.repeat(starts[docs] - (np.cumsum(sizes[docs]) - sizes[docs]), sizes[docs])
            own = own + np.arange(len(own))
            self._search(Bucket(ids[docs], lengths[docs], sizes[docs], terms[own], impacts[own], len(self.weights)), live)

    def _search(self, bucket: Bucket, live: np.ndarray) -> None:
        for q in live:
            terms, counts = self.queries.vectors[q]
            self.buckets_met += 1
            docs = bucket.survivors(terms, counts, int(self.floors[q]))
            if not len(docs):
                continue
            self.rescored += len(docs)
            self.weights[terms] = counts
            scores = bucket.scores(docs, self.weights)
            self.weights[terms] = 0
            good = scores >= self.floors[q]
            if good.any():
                self._keep(q, scores[good], bucket.ids[docs[good]])

    def _keep(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores[q], scores]), np.concatenate([self.found[q], ids])
        best = np.lexsort((ids, -scores))[: self.k]
        self.scores[q], self.found[q] = scores[best], ids[best]
        if len(best) == self.k:
            self.floors[q] = max(self.floors[q], self.scores[q][-1])


# --- search over a table ------------------------------------------------------------------------------------------


def best_rows(counted: DataFrame, queries: Queries, corpus: Corpus, k: int, floors: np.ndarray | None = None) -> DataFrame:
    """(query, key, score): the k best of every task and query. ``floors`` are scores that k documents reach."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Search(queries, corpus, k, None if floors is None else floors.copy())
        for batch in batches:
            ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            terms, tfs = (batch.column(i).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3))
            sizes = batch.column(2).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            best.add(ids, batch.column(1).to_numpy(zero_copy_only=False), sizes, terms, tfs)
        numbers = np.repeat(np.arange(len(queries.ids)), [len(s) for s in best.scores])
        ids, scores = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (best.found, best.scores))
        yield pa.RecordBatch.from_arrays(
            [pa.array(numbers, pa.int32()), pa.array(ids, pa.int64(), mask=ids == NO_ID), pa.array(scores, pa.int64())],
            names=["query", "key", "score"],
        )

    return counted.select("key", "n", "terms", "tfs").mapInArrow(search, "query int, key bigint, score bigint")


def ranked(partial: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("key").asc_nulls_last())
    return partial.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search_block(docs: DataFrame, rows: list[Row], kind: str, k: int, text: str, key: str) -> DataFrame:
    """(item, rank, key, score) of a bounded list of (id, text); ``kind`` is the type of the ids."""
    spark = docs.sparkSession
    queries = Queries.of(rows)
    counted = stored(postings(docs, queries.vocabulary, text, key), "postings")
    corpus = Corpus.of(counted, len(queries.vocabulary))
    # Documents with most query terms, in the tasks that hold them: no limit that one task would have to apply.
    share = min(1.0, SEED_ROWS / max(1, corpus.documents))
    least_terms = counted.agg(F.percentile_approx(F.size("terms"), 1.0 - share)).first()[0]
    longest = counted.filter(F.size("terms") >= F.lit(least_terms))
    floors = np.ones(len(queries.ids), dtype=np.int64)
    for query, number, least in ranked(best_rows(longest, queries, corpus, k), k).groupBy("query").agg(F.count("*"), F.min("score")).collect():
        if number == k:  # so many documents score this or more: a valid threshold for all tasks
            floors[query] = least
    found = ranked(best_rows(counted, queries, corpus, k, floors), k)
    names = spark.createDataFrame(list(enumerate(queries.ids)), f"query int, item {kind}")
    return found.join(names, "query").select("item", "rank", "key", "score")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, text: str = "text", key: str = "doc_id", item: str = "item_id") -> DataFrame:
    """(item, rank, key, score): the k best documents of every item with a score above 0, equal scores by key.

    Items are rows with an ``item`` and a ``text``; repeated rows count once, a null or empty text finds nothing. Documents
    without a term (null, empty, marks only) are found by none and count in no figure; repeated documents are found as
    often as they are there, a null key comes last among equals. Empty tables give an empty result. Other columns are not
    read. The items are sent to all tasks; beyond a bound of bytes they are cut into blocks, one pass each.
    """
    wanted = items.select(F.col(f"`{item}`").alias("item"), F.col(f"`{text}`").alias("text")).distinct()
    total = wanted.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(2 * total / QUERY_BYTES)) if total > QUERY_BYTES else 1
    number = F.pmod(F.xxhash64("item", "text"), F.lit(blocks))
    parts = []
    for block in range(blocks):
        rows = sorted(wanted.filter(number == block).collect(), key=lambda r: (r[0] is None, str(r[0]), r[1] or ""))
        parts.append(search_block(docs, rows, wanted.schema["item"].dataType.simpleString(), k, text, key))
    found = reduce(DataFrame.unionByName, parts)
    return found.withColumnsRenamed({"item": item, "key": key})
