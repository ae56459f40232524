"""Neighbour search, fill-in-the-middle and lexical search, against plain versions."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from brute import UPPER, sha
from conftest import CLASHES, FOLDER, given
from hypothesis import given as example
from hypothesis import settings
from hypothesis import strategies as st
from tools.compare import duck

from trendloom.llm import fill_middle, lexical_search, neighbours
from trendloom.llm.queries import ORACLE_SQL, QUERIES


def sorted_rows(rows):
    return sorted((tuple(r) for r in rows), key=lambda row: tuple((x is not None, x) for x in row))


# Fill in the middle


def plain_fim(doc, text):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    if h[3] % 100 < 80:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.fixture(scope="module")
def fim_rows(texts):
    near_marks = [(10_000 + i, f" a<P b<{i} S> <M\t\n é\U0001f600 c {i}>  ") for i in range(200)]
    return texts + near_marks + [(9100 + i, f"it holds <{m}> {i}") for i, m in enumerate("PSM" * 10)]


def test_forms_are_those_of_the_plain_version(fim_rows, one_each):
    got = fill_middle.round_trips(one_each(fim_rows)).collect()
    expected = []
    for doc, text in fim_rows:
        n, form, prefix, middle, out = plain_fim(doc, text)
        expected.append((doc, n, form, prefix, middle, sha(out), sha(text or "")))
    assert sorted_rows(got) == sorted_rows(expected)
    assert {r[2] for r in expected} == {"plain", "spm", "psm"}


def test_all_columns_stay_beside_the_output(fim_rows, one_each, no_docs):
    docs = one_each(fim_rows)
    made = fill_middle.fill_in_middle(docs)
    assert made.columns == [*docs.columns, "fim"]
    assert sorted_rows(made.select("doc_id", "fim.text").collect()) == sorted_rows((d, plain_fim(d, t)[4]) for d, t in fim_rows)
    assert {tuple(r) for r in made.select(*[f"`{c}`" for c in CLASHES]).distinct().collect()} == {CLASHES}
    assert fill_middle.fill_in_middle(no_docs).collect() == [] and fill_middle.round_trips(no_docs).collect() == []


@settings(max_examples=200, deadline=None)
@example(st.text(alphabet="<>PSM a\né", max_size=30), st.integers(0, 30), st.integers(0, 30), st.sampled_from(["psm", "spm"]))
def test_rotations_come_back(text, a, b, form):
    data = text.encode()
    if any(mark in data for mark in (b"<P>", b"<S>", b"<M>")):
        return
    first, second = sorted((min(a, len(data)), min(b, len(data))))
    assert fill_middle.rearranged(fill_middle.arranged(data, first, second, form), form) == data


def test_a_very_long_text_comes_back():
    data = ("word  \U0001f600 " * 300_000).encode()
    for form in ("psm", "spm"):
        assert fill_middle.rearranged(fill_middle.arranged(data, 1_000_000, 1_700_002, form), form) == data


# Lexical search


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def plain_search(docs, items, k=10):
    """(item, rank, doc_id, score), items by (id, text) once."""
    bags = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    total, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(w for _, b in bags for w in b)
    out = []
    for item, text in set(items):
        wanted, scored = Counter(terms(text)), []
        for doc, bag in bags:
            m = 25 + 75 * sum(bag.values()) * total // length
            score = sum(
                c * math.floor(1000 * math.log((2 * total + 2) / (2 * df[w] + 1))) * (1_000_000_000 * bag[w] // (1000 * bag[w] + 8 * m))
                for w, c in wanted.items() if w in bag
            )
            if score > 0:
                scored.append((-score, doc is None, doc))
        out += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return out


@pytest.fixture(scope="module")
def items():
    return given("benchmark", "item_id, text") + [
        (9001, None), (9002, ""), (9003, "?! ..."), (9004, "nosuchterm"), (9005, "body text the the the"), (9006, "PASSWORD é"), (None, "rows and words"),
        (9005, "body text the the the"), (9007, "squares 400 441 484"),
    ]


def test_best_documents_are_those_of_the_plain_version(docs, texts, items, spark):
    asked = spark.createDataFrame([(i, t, "x", "y") for i, t in items], "item_id long, text string, score string, rank string")
    got = lexical_search.search(docs, asked).select("item_id", "rank", "doc_id", "score").collect()
    assert sorted_rows(got) == sorted_rows(plain_search(texts, items))


def test_items_beyond_the_bound_take_more_passes(docs, texts, items, spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "QUERY_BYTES", 4000)
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = lexical_search.search(docs, asked, k=3).select("item_id", "rank", "doc_id", "score").collect()
    assert sorted_rows(got) == sorted_rows(plain_search(texts, items, 3))


def test_many_copies_tie_by_id(one_each, spark):
    rows = [(i, "alpha beta") for i in range(3000, 0, -1)] + [(5000 + i, f"gamma {i}") for i in range(300)]
    asked = spark.createDataFrame([(1, "beta"), (2, "gamma 7 7")], "item_id long, text string")
    got = {(r.item_id, r["rank"]): r.doc_id for r in lexical_search.search(one_each(rows).repartition(3), asked).collect()}
    assert [got[1, r] for r in range(1, 11)] == list(range(1, 11)) and got[2, 1] == 5007


def test_search_of_empty_tables(docs, no_docs, spark):
    asked, none = spark.createDataFrame([(1, "the text")], "item_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    for frame in (lexical_search.search(no_docs, asked), lexical_search.search(docs, none), lexical_search.search(no_docs, none)):
        assert frame.columns == ["item_id", "rank", "doc_id", "score"] and frame.collect() == []


def test_pruned_buckets_lose_nothing():
    rng = np.random.default_rng(3)
    size, rows = 60, 6000
    vectors = [(np.sort(rng.choice(size, n, replace=False)), rng.integers(1, 4, n)) for n in (1, 2, 5, 12, 30)]
    queries = lexical_search.Queries(list(range(5)), {str(i).encode(): i for i in range(size)}, vectors)
    weights = np.sort(rng.integers(1, 9000, size))[::-1].copy()
    corpus = lexical_search.Corpus(rows, rows * 40, weights)
    n = rng.integers(5, 400, rows)
    sizes = rng.integers(0, 9, rows)
    terms_of = [rng.choice(size, s, replace=False) for s in sizes]
    tfs = rng.integers(1, 6, sizes.sum())
    search = lexical_search.Search(queries, corpus, 10)
    search.add(np.arange(rows), n, sizes, np.concatenate(terms_of), tfs)
    impacts = corpus.impacts(n, np.concatenate(terms_of), tfs, sizes)
    dense = np.zeros((rows, size), dtype=np.int64)
    dense[np.repeat(np.arange(rows), sizes), np.concatenate(terms_of)] = impacts
    for q, (own, counts) in enumerate(vectors):
        scores = dense[:, own] @ counts
        best = [i for i in np.lexsort((np.arange(rows), -scores))[:10] if scores[i] > 0]
        assert search.found[q].tolist() == best and search.scores[q].tolist() == scores[best].tolist()
    assert search.rescored < 0.5 * rows * len(vectors)


# Neighbours


def plain_neighbours(rows, k=20, every=20):
    good = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, v in good:
        if q % every == 0:
            scored = [(-float((np.array(v) * np.array(w)).sum()), i) for i, w in good if i != q and len(w) == len(v)]
            out[q] = [(i, -s) for s, i in sorted(scored)[:k]]
    return out


def found_neighbours(frame):
    out = {}
    for r in frame.collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert all([p[0] for p in sorted(v)] == list(range(1, len(v) + 1)) for v in out.values())
    return {q: [(i, s) for _, i, s in sorted(v)] for q, v in out.items()}


SCHEMA = "vec_id long, embedding array<float>, label int, score string, `class` string, cell string, v string"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, 1, "a", "b", "c", "d") for i, v in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd_vectors():
    rng = np.random.default_rng(11)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6) * (1 + i % 3)]) for i in range(400)]
    hot = rows[7][1]
    rows += [(400 + i, hot) for i in range(200)]
    return rows + [
        (1000, None), (1020, []), (1040, [0.0] * 6), (1060, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1080, [float("nan")] * 6), (1100, [float("inf")] + [1.0] * 5),
        (None, [1.0] * 6), (2000, [1.0, 2.0]), (2001, [2.0, 1.0]), (2020, [-1.0, 0.0]), (40, rows[40][1]), (60, rows[61][1]), (3000, [-0.0, 1.0] + [0.0] * 4), (3020, [0.0, 1.0] + [0.0] * 4),
    ]


def test_without_a_stopping_test_the_search_is_exact(spark, odd_vectors, monkeypatch):
    monkeypatch.setattr(neighbours, "CONFIDENCE", 1 - 1e-15)
    monkeypatch.setattr(neighbours, "PART_NUMBERS", 6 * 40)
    monkeypatch.setattr(neighbours, "ASKED_NUMBERS", 6 * 5)
    table = vectors_of(spark, [r for r in odd_vectors if r[0] != 60])
    got, expected = found_neighbours(neighbours.nearest(table)), plain_neighbours([r for r in odd_vectors if r[0] != 60])
    assert got == expected


def test_odd_vectors_and_few_candidates(spark, odd_vectors):
    once = [r for r in odd_vectors if r[0] != 60]
    got, expected = found_neighbours(neighbours.nearest(vectors_of(spark, once))), plain_neighbours(once)
    assert neighbours.nearest(vectors_of(spark, odd_vectors)).filter("query_id = 60").count() == 40  # its two vectors
    assert set(got) == set(expected) and not {1000, 1020, 1040, 1060, 1080, 1100} & set(got)
    assert [i for i, _ in got[2000]] == [2001, 2020]
    few = neighbours.nearest(vectors_of(spark, [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0])]))
    assert found_neighbours(few) == {0: [(1, 1.0), (2, 1.0)]}
    for rows in ([], [(0, [1.0])], [(1, [1.0]), (3, [2.0])]):
        assert neighbours.nearest(vectors_of(spark, rows)).collect() == []


@pytest.mark.parametrize("part_numbers", [neighbours.PART_NUMBERS, 64 * 100])
def test_recall_on_the_given_vectors(spark, monkeypatch, part_numbers):
    monkeypatch.setattr(neighbours, "PART_NUMBERS", part_numbers)
    table = pq.read_table("/root/testdata/sf0.1/embeddings.parquet")
    ids, matrix = table["vec_id"].to_numpy(), np.stack(table["embedding"].to_pylist()).astype(np.float64)
    got = found_neighbours(neighbours.nearest(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")))
    assert len(got) == (ids % 20 == 0).sum()
    hits = 0
    for q, found in got.items():
        scores = (matrix * matrix[ids == q][0]).sum(axis=1)
        scores[ids == q] = -np.inf
        hits += len(set(ids[np.lexsort((ids, -scores))[:20]]) & {i for i, _ in found})
        assert len(found) == 20 and [s for _, s in found] == [scores[ids == i][0] for i, _ in found]
    assert hits >= 0.93 * 20 * len(got)


def test_quantiles_of_chi_square():
    for p, degrees, value in ((0.95, 2, 5.991465), (0.95, 8, 15.507313), (0.9, 12, 18.549348)):
        assert abs(neighbours.chi_square_quantile(p, degrees) - value) < 1e-5


def test_the_tree_leaves_vectors_out():
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(40, 16))
    rows = np.repeat(centers, 100, axis=0) + 0.05 * rng.normal(size=(4000, 16))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    projection = neighbours.Projection.of(16, 1.0)
    tree = neighbours.KdTree(rows, projection)
    degrees = neighbours.chi_square_quantile(0.95, neighbours.PROJECTED)
    radii, met = [], 0
    for q in range(0, 4000, 400):
        query, scale = rows[q], projection.scale(rows[q : q + 1])[0]
        radius = lambda kth, s=scale: np.inf if kth == -np.inf else degrees * projection.distance(kth, s)
        found, scores = tree.best(query, projection.queries(rows[q : q + 1])[0], radius, 20, -np.inf)
        exact = np.sort(rows @ query)[::-1][:20]
        met += len(np.intersect1d(np.argsort(-(rows @ query))[:20], found))
        away = ((projection.vectors(rows) - projection.queries(rows[q : q + 1])[0]) ** 2).sum(axis=1)
        radii.append((away <= radius(exact[-1])).mean())
    assert met >= 0.9 * 200 and np.mean(radii) < 0.2


# SQL


@pytest.mark.parametrize("name", ["op12_fill_in_middle", "op13_lexical_search"])
def test_sql_twins_of_retrieval(spark, name):
    got = QUERIES[name](spark, FOLDER)
    found = duck(FOLDER).execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted_rows(got.select(*names).collect()) == sorted_rows(found.fetchall())
