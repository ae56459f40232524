"""Substring search by trigram postings gives what a scan gives, and reads less."""

import random

import pytest
from pyspark.sql import functions as F

from trendloom.operators.subject_index import SubjectIndex


@pytest.fixture(scope="module")
def subjects():
    rng = random.Random(3)
    words = ["Login", "payment", "Späti", "wheel", "100%", "a.b*c", "re-fund", "the", "X", "Ünïcode", "mouse", "\U0001f600ok"]
    rows = [(f"t{i:04d}", " ".join(rng.choice(words) for _ in range(rng.randint(0, 4)))) for i in range(600)]
    rows += [(f"h{i:04d}", "the hot subject") for i in range(300)] + [("n1", None), ("q1", "it holds zqxj once")]
    return rows


@pytest.fixture(scope="module")
def index(spark, subjects, tmp_path_factory):
    table = spark.createDataFrame(subjects, "id string, subject string")
    return SubjectIndex.build(table, str(tmp_path_factory.mktemp("index") / "subjects"), buckets=16)


@pytest.mark.parametrize("text", ["login", "PAY", "the hot", "mouse wheel", "x", "", "späti", "0% a", "b*c", "\U0001f600o", "zqxj", "nothing here", "the the", "%"])
def test_search_equals_a_scan(index, subjects, text):
    got = sorted(r["ticket_id"] for r in index.tickets_with(text).collect())
    assert got == sorted(i for i, s in subjects if s is not None and text.lower() in s.lower())


def test_a_search_reads_few_rows(index, subjects):
    found = index.tickets_with("zqxj")
    assert [r["ticket_id"] for r in found.collect()] == ["q1"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    filters = [part.split("]")[0] for part in plan.split("PartitionFilters: [")[1:]]
    assert len(filters) >= 3 and all("bucket#" in f and len(f) < 200 for f in filters)  # few partitions of every table
    assert index._in_buckets(index.links, index.candidates("zqxj")).select("bucket").distinct().count() == 1
    assert index._of(index.postings, ["zqx"]).count() == 1 < index.postings.count()
    assert index.candidates("zqxj").count() == 1
    different = len({s.lower() for _, s in subjects if s is not None})
    assert index.candidates("hot subject").count() == 1 < different


def test_no_tickets(spark, tmp_path):
    empty = SubjectIndex.build(spark.createDataFrame([], "id string, subject string"), str(tmp_path / "none"))
    assert empty.tickets_with("abc").collect() == [] and empty.tickets_with("a").collect() == []
    assert empty.links.filter(F.lit(True)).count() == 0
