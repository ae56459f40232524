"""Similarity, assignment and clustering against brute force."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trendloom.functions import vectors
from trendloom.operators import clustering, similarity, vector_index
from trendloom.operators.similarity import SmallVectors

RNG = np.random.default_rng(7)


def cosine(a, b):
    d = np.linalg.norm(a) * np.linalg.norm(b)
    return float(np.dot(a, b) / d) if d else 0.0


def table(rows, matrix, prefix="t"):
    return rows([(f"{prefix}{i:04d}", [float(x) for x in v]) for i, v in enumerate(matrix)], "id string, embedding array<double>")


def test_cosine_edges(rows):
    df = rows(
        [(1, [1.0, 0.0], [0.0, 2.0]), (2, [0.0, 0.0], [1.0, 1.0]), (3, [1.0], [1.0, 1.0]), (4, None, [1.0]), (5, [3.0, 4.0], [6.0, 8.0])],
        "i int, a array<double>, b array<double>",
    )
    got = [r[0] for r in df.orderBy("i").select(vectors.cosine(F.col("a"), F.col("b"))).collect()]
    assert got[:4] == [0.0, 0.0, 0.0, None] and math.isclose(got[4], 1.0)


def test_parse_and_usable(rows):
    df = rows([("[0.1, 0.2]",), ("bad",), ("[]",), (None,), ("[0, 0]",), ("[1]",)], "t string")
    parsed = df.select(vectors.parse_vector(F.col("t")).alias("v"))
    assert [r[0] for r in parsed.select(vectors.usable(F.col("v"))).collect()] == [True, False, False, False, False, True]
    assert [r[0] for r in parsed.select(vectors.usable(F.col("v"), 2)).collect()] == [True, False, False, False, False, False]


def test_scores_shown(rows):
    df = rows([(1.23456789,), (float("nan"),), (float("-inf"),), (None,)], "s double")
    assert [r[0] for r in df.select(vectors.shown_score(F.col("s"))).collect()] == [1.234568, None, None, None]


def test_nearest_centroid_edges(rows):
    clusters = rows(
        [("b", [1.0, 0.0]), ("a", [2.0, 0.0]), ("c", [0.0, 1.0]), ("none", None)], "id string, centroid_embedding array<double>"
    )
    tickets = rows(
        [("east", [5.0, 0.0]), ("north", [0.0, 3.0]), ("zero", [0.0, 0.0]), ("long", [1.0, 1.0, 1.0]), ("null", None), ("nan", [float("nan"), 1.0])],
        "id string, embedding array<float>",
    )
    got = {r["id"]: (r["cluster_id"], r["similarity_score"]) for r in similarity.nearest_centroid(tickets, clusters).collect()}
    none = (None, None)
    assert got == {"east": ("a", 1.0), "north": ("c", 1.0), "zero": ("a", 0.0), "long": none, "null": none, "nan": none}
    empty = similarity.nearest_centroid(tickets, clusters.filter("false")).collect()
    assert {r["cluster_id"] for r in empty} == {None}


def test_topk_by_scan_and_by_blocks(rows, monkeypatch):
    corpus, queries = RNG.normal(size=(300, 8)), RNG.normal(size=(17, 8))
    corpus[50:150] = corpus[0]  # a third are copies: ties break by id
    c, q = table(rows, corpus), table(rows, queries, "q").withColumnRenamed("id", "query_id")
    want = {}
    for i, v in enumerate(queries):
        scored = [(-round(cosine(v, x), 12), f"t{j:04d}") for j, x in enumerate(corpus) if round(cosine(v, x), 12) > 0.1]
        want[f"q{i:04d}"] = [t for _, t in sorted(scored)[:5]]

    def answer(df):
        found = {}
        for r in df.orderBy("query_id", "rank").collect():
            found.setdefault(r["query_id"], []).append(r["match_id"])
        return found

    want = {k: v for k, v in want.items() if v}
    assert answer(similarity.similar_topk(c, q, 5, 0.1)) == want
    monkeypatch.setattr(similarity, "SMALL_SIDE_ROWS", 5)
    monkeypatch.setattr(similarity, "BLOCK_CELLS", 320)
    monkeypatch.setattr(similarity, "SCORES_AT_ONCE", 50)
    assert answer(similarity.similar_topk(c, q, 5, 0.1)) == want


def test_nearest_beyond_the_size_bound(rows, monkeypatch):
    tickets = table(rows, RNG.normal(size=(60, 6)))
    clusters = table(rows, RNG.normal(size=(30, 6)), "c").withColumnRenamed("embedding", "centroid_embedding")
    small = {r["id"]: r["cluster_id"] for r in similarity.nearest_centroid(tickets, clusters).collect()}
    monkeypatch.setattr(similarity, "SMALL_SIDE_ROWS", 3)
    monkeypatch.setattr(similarity, "BLOCK_CELLS", 100)
    assert {r["id"]: r["cluster_id"] for r in similarity.nearest_centroid(tickets, clusters).collect()} == small


def test_search_arguments():
    assert similarity.search_arguments(-1, 10) == (0.0, 10)
    assert similarity.search_arguments(7, 1000) == (1.0, 50)


def test_strict_threshold(rows):
    tickets = rows(
        [("a", "a", "s", "d", "Low", "t", "p", [1.0, 0.0]), ("b", "b", "s", "d", "Low", "t", "p", [0.6, 0.8]), ("c", "c", "s", "d", "Low", "t", "p", None)],
        "id string, ticket_id string, subject string, description string, priority string, ticket_type string, product_area string, embedding array<double>",
    ).withColumn("created_at", F.lit("2026-01-01").cast("timestamp"))
    assert [r["id"] for r in similarity.find_similar(tickets, [1.0, 0.0], 0.6).collect()] == ["a"]
    assert [r["id"] for r in similarity.find_similar(tickets, [1.0, 0.0], 0.59).collect()] == ["a", "b"]
    assert similarity.find_similar(tickets, [1.0, 0.0], 0.0, 1).count() == 1


def grouped(groups, each, dim, spread=0.15):
    """Vectors in tight groups, with a zero vector and copies among them."""
    rng = np.random.default_rng(groups)
    matrix = np.repeat(rng.normal(size=(groups, dim)), each, axis=0) + spread * rng.normal(size=(groups * each, dim))
    matrix[5] = 0
    matrix[40:60] = matrix[40]
    return matrix


def test_an_exact_search_of_the_index_is_the_scan(rows, tmp_path):
    for name, matrix in (("loose", RNG.normal(size=(300, 12))), ("tight", grouped(20, 20, 12))):
        tickets = table(rows, matrix)
        index = vector_index.VectorIndex.build(tickets, str(tmp_path / name))
        for query in (matrix[0], matrix[45], -matrix[17], np.ones(12), np.zeros(12)):
            for threshold, limit in ((0.6, 10), (0.1, 3), (-0.5, 40)):
                scored = sorted((-round(cosine(query, v), 12), f"t{i:04d}") for i, v in enumerate(matrix))
                want = [(i, -s) for s, i in scored if -s > threshold][:limit]
                got = index.search(list(query), threshold, limit, exact=True).collect()
                assert [(r["key"], pytest.approx(r["similarity"], abs=1e-9)) for r in got] == [(i, pytest.approx(s, abs=1e-9)) for i, s in want]
        assert index.search([1.0, 2.0]).collect() == []


def test_a_search_reads_only_the_partitions_of_its_cells(rows, tmp_path):
    matrix = grouped(40, 25, 16)
    index = vector_index.VectorIndex.build(table(rows, matrix), str(tmp_path / "index"))
    assert index.probes < 0.5 * len(index.cells.ids)
    for exact in (False, True):
        found = index.search(list(matrix[100]), 0.6, 10, exact=exact)
        read = {f.split("cell=")[1].split("/")[0] for f in found.inputFiles()}
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [" in plan and "cell#" in plan
        assert 0 < len(read) <= len(index.cells.ids)
        listed = plan.split("PartitionFilters: [")[1].split("]")[0]
        assert listed


def test_recall_of_the_probed_cells(spark, tmp_path):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").withColumnRenamed("vec_id", "id")
    index = vector_index.VectorIndex.build(table, str(tmp_path / "index"))
    found = share = 0
    vectors_of = dict(table.orderBy("id").limit(25).select("id", "embedding").collect())
    exact = {}
    queries = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in vectors_of.items()], "query_id long, embedding array<double>")
    for r in similarity.similar_topk(table, queries, 10, None).collect():
        exact.setdefault(r["query_id"], set()).add(r["match_id"])
    for i, query in vectors_of.items():
        got = {r["key"] for r in index.search([float(x) for x in query], -1.0, 10).collect()}
        found += len(got & exact[i])
        share += len(exact[i])
    assert found >= 0.9 * share and index.probes < len(index.cells.ids)


def test_two_large_sides_meet_in_few_cells(rows, monkeypatch):
    corpus, queries = grouped(30, 40, 16), grouped(30, 40, 16)[::7] + 0.01
    c, q = table(rows, corpus), table(rows, queries, "q")
    for k, threshold in ((5, None), (3, 0.8)):
        monkeypatch.setattr(similarity, "BLOCK_CELLS", 16 * 50)
        found = vector_index.pruned_topk(c, q, k, threshold, "id", "embedding", "id", "embedding")
        got = sorted((r["query_id"], r["rank"], r["match_id"]) for r in found.collect())
        want = []
        for i, v in enumerate(queries):
            scored = sorted((-round(cosine(v, x), 12), f"t{j:04d}") for j, x in enumerate(corpus))
            want += [(f"q{i:04d}", n + 1, j) for n, (s, j) in enumerate(scored[:k]) if threshold is None or -s > threshold]
        assert got == sorted(want)
        _, further, _ = vector_index.first_round(*[vector_index.whole_vectors(x, "id", "embedding", 16) for x in (c, q)], k, threshold, 16)
        cells = round(math.sqrt(len(corpus)))
        assert further.count() < 0.25 * len(queries) * cells


def test_a_query_travels_once_to_a_block(rows, monkeypatch):
    corpus = RNG.normal(size=(600, 16))  # no cell can be left out
    frame = table(rows, corpus)
    monkeypatch.setattr(similarity, "BLOCK_CELLS", 16 * 100)
    values = vector_index.whole_vectors(frame, "id", "embedding", 16)
    first, further, meet = vector_index.first_round(values, values, 3, None, 16)
    assert further.count() <= 12 * len(corpus)  # a block has half of 100 vectors at least; cells are 24
    found = vector_index.pruned_topk(frame, frame, 3, None, "id", "embedding", "id", "embedding")
    got = {(r["query_id"], r["rank"]): r["match_id"] for r in found.collect()}
    units = corpus / np.linalg.norm(corpus, axis=1, keepdims=True)
    order = np.argsort(-np.round(units @ units.T, 12), axis=1, kind="stable")[:, :3]
    assert got == {(f"t{i:04d}", n + 1): f"t{j:04d}" for i, row in enumerate(order) for n, j in enumerate(row)}


def test_best_matches_that_come_in_pieces(monkeypatch):
    monkeypatch.setattr(similarity, "SCORES_AT_ONCE", 60)
    monkeypatch.setattr(similarity, "HITS_AT_ONCE", 20)
    corpus = np.repeat(RNG.normal(size=(40, 4)), 3, axis=0)  # ties
    units = corpus[::9] / np.linalg.norm(corpus[::9], axis=1, keepdims=True)
    ids = RNG.permutation(len(corpus))
    scores = np.round(corpus / np.linalg.norm(corpus, axis=1, keepdims=True) @ units.T, 12)
    for threshold in (None, 0.5):
        best = similarity._Best(units, 4, threshold)
        for at in range(0, len(corpus), 25):
            best.add(ids[at : at + 25], corpus[at : at + 25])
        got = {q: g["match"].tolist() for q, g in best.rows().groupby("query")}
        want = {}
        for q in range(len(units)):
            ranked = sorted((-s, i) for s, i in zip(scores[:, q], ids) if threshold is None or s > threshold)
            want[q] = [i for _, i in ranked[:4]]
        assert got == want


@pytest.mark.parametrize("n, k", [(6, None), (7, 7), (83, 7), (84, 7), (95, 7), (96, 8), (239, 19), (240, 20), (251, 20), (252, 20)])
def test_dynamic_k(n, k):
    assert clustering.dynamic_k(n) == k


def brute_lloyd(points, centroids, rounds):
    centroids = centroids.copy()
    for _ in range(rounds):
        labels = [max(range(len(centroids)), key=lambda c: (round(cosine(p, centroids[c]), 12), -c)) for p in points]
        for c in range(len(centroids)):
            if c in labels:
                centroids[c] = points[[label == c for label in labels]].mean(axis=0)
    return centroids, [max(range(len(centroids)), key=lambda c: (round(cosine(p, centroids[c]), 12), -c)) for p in points]


@pytest.mark.parametrize("rounds", [0, 1, 4])
def test_lloyd_equals_brute_force(rows, rounds):
    points = RNG.normal(size=(120, 5))
    start = np.vstack([points[:4], [[-9, -9, -9, -9, 9.0]]])
    found = clustering.lloyd(table(rows, points), SmallVectors([f"c{i}" for i in range(5)], start), rounds)
    centroids, labels = brute_lloyd(points, start, rounds)
    np.testing.assert_allclose(found.centroids.matrix, centroids, atol=1e-9)
    got = {r["id"]: r["cluster_id"] for r in found.rows.collect()}
    assert got == {f"t{i:04d}": f"c{label}" for i, label in enumerate(labels)}


def test_empty_cluster_keeps_its_centroid(rows):
    found = clustering.lloyd(table(rows, [[1.0, 0.0], [1.0, 0.1]]), SmallVectors(["x", "y"], np.array([[1.0, 0.0], [-1.0, 0.0]])), 5)
    assert found.centroids.matrix[1].tolist() == [-1.0, 0.0] and found.rounds < 5


@pytest.mark.parametrize("measure", ["euclidean", "cosine"])
def test_kmeans_finds_separate_groups(rows, measure):
    groups = [[1, 0, 0], [0, 1, 0], [0, 0, 1]]
    points = np.vstack([np.array(g) * s + RNG.normal(scale=0.01, size=3) for g in groups for s in range(1, 15)])
    usable = clustering.usable_tickets(table(rows, np.vstack([points, np.zeros((1, 3))])))
    found = clustering.kmeans(usable, 3, measure, starts=3)
    members = clustering.membership(found.rows).collect()
    assert len(members) == 42
    by_cluster = {}
    for m in members:
        by_cluster.setdefault(m["cluster_id"], set()).add(int(m["ticket_id"][1:]) // 14)
    assert sorted(len(v) for v in by_cluster.values()) == [1, 1, 1]
    assert all(m["similarity_score"] > 0.99 for m in members)
    assert {m["similarity_score"] for m in clustering.membership(found.rows, score="const").collect()} == {1.0}


def test_cluster_ids_survive():
    old = SmallVectors(["A", "B"], np.array([[1.0, 0.0], [0.0, 1.0]]))
    new = SmallVectors(["0000", "0001", "0002"], np.array([[0.05, 1.0], [0.7, 0.7], [1.0, 0.02]]))
    assert clustering.keep_cluster_ids(new, old) == ["B", "0001", "A"]
    assert clustering.keep_cluster_ids(new, None) == new.ids


def test_permuted_cluster_ids_survive():
    unit = np.eye(3)
    ids = ["0000", "0001", "0002"]
    assert clustering.keep_cluster_ids(SmallVectors(ids, unit[[2, 0, 1]]), SmallVectors(ids, unit)) == ["0002", "0000", "0001"]
    other = clustering.keep_cluster_ids(SmallVectors(ids, np.array([[1.0, 1, 1], [1, 0, 0], [0, 1, 0]])), SmallVectors(ids, unit))
    assert other[1:] == ["0000", "0001"] and other[0] not in ids and len(set(other)) == 3


def test_assignment_has_the_largest_total():
    for rows, columns in ((1, 1), (3, 3), (2, 5), (5, 2), (6, 6)):
        for _ in range(30):
            gain = np.where(RNG.random((rows, columns)) < 0.4, 0.0, RNG.random((rows, columns)))
            size = max(rows, columns)
            padded = np.zeros((size, size))
            padded[:rows, :columns] = gain
            best = max(padded[np.arange(size), list(p)].sum() for p in itertools.permutations(range(size)))
            found = clustering.best_assignment(gain)
            assert len(set(found)) == rows and math.isclose(sum(padded[r, c] for r, c in enumerate(found)), best, abs_tol=1e-9)


def test_ids_are_kept_where_the_best_pair_first_would_lose_similarity():
    angles = np.deg2rad([0, 20])
    old = SmallVectors(["A", "B"], np.c_[np.cos(angles), np.sin(angles)])
    moved = np.deg2rad([10.5, 26])  # 10.5 is nearest to B by a hair, 26 fits B alone
    new = SmallVectors(["0", "1"], np.c_[np.cos(moved), np.sin(moved)])
    assert clustering.keep_cluster_ids(new, old, 0.95) == ["A", "B"]


def test_a_misfit_centroid_concerns_no_other_ticket(rows, monkeypatch):
    tickets = rows([("a", [0.0, 1.0]), ("b", [1.0, 0.0, 0.0]), ("c", [1.0]), ("d", None)], "id string, embedding array<double>")
    clusters = rows(
        [("c1", [1.0, 0.1]), ("c2", [0.1, 1.0]), ("c3", [1.0, 1.0, 0.0]), ("c4", None)], "id string, centroid_embedding array<double>"
    )
    wanted = {"a": "c2", "b": "c3", "c": None, "d": None}
    assert {r["id"]: r["cluster_id"] for r in similarity.nearest_centroid(tickets, clusters).collect()} == wanted
    queries = clusters.withColumnsRenamed({"id": "query_id", "centroid_embedding": "embedding"})
    small = sorted(map(tuple, similarity.similar_topk(tickets, queries, 2, None).collect()))
    monkeypatch.setattr(similarity, "SMALL_SIDE_ROWS", 0)
    assert {r["id"]: r["cluster_id"] for r in similarity.nearest_centroid(tickets, clusters).collect()} == wanted
    assert sorted(map(tuple, similarity.similar_topk(tickets, queries, 2, None).collect())) == small


def test_euclidean_members_belong_to_the_nearest_center(rows):
    points = RNG.normal(size=(80, 4))
    found = clustering.kmeans(table(rows, points), 5, "euclidean")
    centers = found.centroids.matrix
    for r in found.rows.collect():
        unit = np.array(r["embedding"]) / np.linalg.norm(r["embedding"])
        assert int(r["cluster_id"]) == int(((centers - unit) ** 2).sum(axis=1).argmin())


def plain_starts(units, centres, rounds, tolerance=1e-4):
    """Lloyd from each start on its own: (centres, cost, rounds)."""
    out = []
    for c in centres:
        c, n = c.copy(), 0
        for n in range(1, rounds + 1):
            own = np.round(units @ c.T - (c**2).sum(axis=1) / 2, 12).argmax(axis=1)
            moved = np.array([units[own == i].mean(axis=0) if (own == i).any() else c[i] for i in range(len(c))])
            shift, c = np.sqrt(((moved - c) ** 2).sum(axis=1)).max(), moved
            if shift <= tolerance:
                break
        out.append((c, ((units[:, None] - c) ** 2).sum(axis=2).min(axis=1).sum(), n))
    return out


def test_all_starts_advance_in_the_same_scans(rows, monkeypatch):
    points = RNG.normal(size=(120, 5)) * RNG.uniform(0.5, 4, size=(120, 1))
    units = points / np.linalg.norm(points, axis=1, keepdims=True)
    centres = np.stack([clustering.spread_seeds(units, 6, np.random.default_rng(i)) for i in range(5)])
    scans, one_round = [], clustering._starts_round
    monkeypatch.setattr(clustering, "_starts_round", lambda r, c, v: scans.append(len(c)) or one_round(r, c, v))
    found = clustering.lloyd_starts(table(rows, points).repartition(3), centres, 300)
    want = plain_starts(units, centres, 300)
    for i, (c, cost, n) in enumerate(want):
        np.testing.assert_allclose(found.centres[i], c, atol=1e-9)
        assert math.isclose(found.costs[i].sum(), cost, abs_tol=1e-9) and found.rounds[i] == n and found.members[i].sum() == 120
    slowest = max(n for _, _, n in want)
    assert len(scans) == slowest + 1 and scans[0] == scans[-1] == 5 and min(scans) < 5


def test_a_round_of_the_starts_needs_no_conversion_and_no_shuffle(spark, rows, monkeypatch):
    points = np.vstack([RNG.normal(size=(90, 5)) * 3, np.full((1, 5), np.nan), np.zeros((2, 5))])
    seen, one_round = [], clustering._starts_round

    def watched(r, c, v):
        seen.append((r.columns, r.storageLevel.useMemory, r.rdd.getNumPartitions()))
        return one_round(r, c, v)

    monkeypatch.setattr(clustering, "_starts_round", watched)
    found = clustering.lloyd_starts(table(rows, points).repartition(30), RNG.normal(size=(3, 4, 5)), 5)
    assert {tuple(c) for c, _, _ in seen} == {("unit",)} and all(kept for _, kept, _ in seen)
    assert max(n for _, _, n in seen) <= spark.sparkContext.defaultParallelism
    assert found.members.sum(axis=1).tolist() == [92] * 3  # zero vectors as before, not-finite ones never


def test_euclidean_takes_the_best_of_ten_starts(rows, monkeypatch):
    seen, lloyd_starts = [], clustering.lloyd_starts
    monkeypatch.setattr(clustering, "lloyd_starts", lambda *a, **k: seen.append((a, lloyd_starts(*a, **k))) or seen[-1][1])
    frame = table(rows, np.vstack([RNG.normal(size=(60, 4)), np.zeros((1, 4))]))
    found = clustering.kmeans(frame, 8, "euclidean")
    (arguments, starts), = seen
    assert arguments[1].shape == (10, 8, 4) and arguments[2] == 300
    assert found.fit == -starts.costs.sum(axis=1).min()
    assert clustering.kmeans(frame, 8, "euclidean").fit == found.fit


def test_few_different_vectors_leave_clusters_empty(rows):
    frame = table(rows, np.repeat(np.eye(3), 4, axis=0))
    found = clustering.kmeans(frame, 5, "euclidean")
    assert math.isclose(found.fit, 0, abs_tol=1e-12) and found.rows.select("cluster_id").distinct().count() == 3


def test_cosine_centroids_are_means_of_raw_vectors(rows):
    points = RNG.normal(size=(90, 4)) * RNG.uniform(0.1, 9, size=(90, 1))
    found = clustering.kmeans(table(rows, points), 4, "cosine", starts=2, max_iter=200)
    means = {r["cluster_id"]: r["centroid"] for r in clustering.cluster_centroids(found.rows).collect()}
    for name, center in zip(found.centroids.ids, found.centroids.matrix):
        np.testing.assert_allclose(center, means[name], atol=1e-9)
