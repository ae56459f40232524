"""Stored versions, upserts, job runs, constraints and sampling."""

import hashlib

import pytest
from pyspark.sql import functions as F

from trendloom import schemas
from trendloom.operators import constraints, ranking, sampling, upsert
from trendloom.sources.jobs import current_runs, job_run, latest_jobs
from trendloom.sources.store import TicketStore

BATCH = "ticket_id string, subject string, created_at timestamp, dated boolean, seq int"


@pytest.fixture
def store(spark, tmp_path):
    return TicketStore(spark, str(tmp_path / "store"))


def at(day):
    return F.to_timestamp(F.lit(day))


def batch(rows, data):
    return rows([(t, s, None, dated, seq) for t, s, _, dated, seq in data], BATCH).withColumn(
        "created_at", F.element_at(F.create_map(*[x for t, s, day, d, seq in data for x in (F.lit(seq), at(day))]), F.col("seq"))
    )


def content(df):
    return {(r["ticket_id"], r["subject"], str(r["created_at"].date())) for r in df.select("ticket_id", "subject", "created_at").collect()}


def test_empty_store(store):
    assert store.read("tickets").count() == 0
    assert store.read("tickets").schema.names == schemas.TICKETS.names


def test_upsert_keeps_the_stored_date_of_undated_rows_and_is_idempotent(rows, store):
    first = [("a", "a1", "2026-01-01", True, 1), ("b", "b1", "2026-01-02", True, 2)]
    second = [("b", "b2", "2026-03-01", False, 1), ("b", "b3", "2026-03-01", False, 2), ("c", "c1", "2026-03-01", False, 3), ("a", "a2", "2026-02-01", True, 4)]
    want = {("a", "a2", "2026-02-01"), ("b", "b3", "2026-01-02"), ("c", "c1", "2026-03-01")}

    store.upsert("tickets", upsert.upsert_batch(store.read("tickets"), batch(rows, first)))
    existing = batch(rows, first).drop("dated", "seq")
    for _ in range(2):
        store.upsert("tickets", upsert.upsert_batch(store.read("tickets"), batch(rows, second)))
        assert content(store.read("tickets")) == want
        assert content(upsert.upsert_tickets(existing, batch(rows, second))) == want
    store.compact("tickets", ("created_at", "ticket_id"))
    assert content(store.read("tickets")) == want
    store.append("tickets", batch(rows, [("d", "d1", "2026-03-02", True, 1)]))
    assert store.read("tickets", "ticket_id").count() == 4
    store.clear("tickets")
    assert store.read("tickets").count() == 0


def test_no_write_that_overlaps_a_new_base_is_lost(rows, store):
    def one(name):
        return batch(rows, [(name, "s", "2026-01-01", True, 1)])

    def ids():
        return sorted(r["ticket_id"] for r in store.read("tickets", "ticket_id").collect())

    store.replace("tickets", one("a"))
    staged = store.stage("tickets", one("b"))
    store.compact("tickets")
    store.commit(("tickets", "append", staged))
    assert ids() == ["a", "b"]

    replaces, seen = store.visible("tickets"), store.read("tickets")
    store.append("tickets", one("c"))
    store.upsert("tickets", one("d"))
    store.replace("tickets", seen, replaces=replaces)
    assert ids() == ["a", "b", "c", "d"]
    with pytest.raises(RuntimeError):
        store.replace("tickets", seen, replaces=replaces)
    assert ids() == ["a", "b", "c", "d"]


def test_job_log_keeps_its_own_rules(store):
    with job_run(store, "recluster"):
        pass
    report = constraints.constraint_report({"job_runs": store.read("job_runs")}).collect()
    assert {r["violations"] for r in report} == {0}


def test_staged_rows_are_not_seen_before_their_commit(rows, store):
    store.replace("tickets", batch(rows, [("a", "x", "2026-01-01", True, 1)]))
    version = store.stage("tickets", batch(rows, [("b", "y", "2026-01-01", True, 1)]))
    assert [r["ticket_id"] for r in store.read("tickets").collect()] == ["a"]
    store.commit(("tickets", "base", version, store.visible("tickets")))
    assert [r["ticket_id"] for r in store.read("tickets").collect()] == ["b"]


def test_member_upsert(rows):
    keys = "ticket_id string, cluster_id string, similarity_score double"
    old = rows([("a", "x", 0.1), ("b", "x", 0.2)], keys)
    new = rows([("a", "x", 0.9), ("a", "y", 0.5)], keys)
    got = {tuple(r) for r in upsert.upsert_members(old, new).collect()}
    assert got == {("a", "x", 0.9), ("a", "y", 0.5), ("b", "x", 0.2)}


def test_cascade(rows):
    members = rows([("a", "x"), ("b", "x"), ("a", "y")], "ticket_id string, cluster_id string")
    got = upsert.cascade(members, rows([("a",)], "id string"), rows([("x",)], "id string")).collect()
    assert [(r["ticket_id"], r["cluster_id"]) for r in got] == [("a", "x")]


def test_job_runs(store):
    with job_run(store, "csv_upload") as run:
        run.tickets_processed = 5
    with pytest.raises(ZeroDivisionError):
        with job_run(store, "recluster") as run:
            run.tickets_processed = 9
            1 / 0
    log = store.read("job_runs")
    assert log.count() == 4
    got = {r["job_type"]: (r["status"], r["tickets_processed"], r["error_message"]) for r in latest_jobs(log).collect()}
    assert got == {"csv_upload": ("success", 5, None), "recluster": ("failed", 0, "division by zero")}
    assert current_runs(log).count() == 2


def test_constraint_report(rows):
    tickets = rows(
        [("1", "a", "s", "d", "Low", [1.0, 2.0]), ("1", "a", None, "d", "low", [1.0]), ("3", None, "s", "d", None, None)],
        "id string, ticket_id string, subject string, description string, priority string, embedding array<float>",
    ).withColumn("created_at", F.current_timestamp())
    members = rows([("1", "x"), ("1", "x"), ("9", "x"), ("9", "z")], "ticket_id string, cluster_id string")
    clusters = rows([("x", "X", "Stable", [0.0, 0.0])], "id string, name string, trend string, centroid_embedding array<double>")
    report = constraints.constraint_report({"tickets": tickets, "issue_clusters": clusters, "cluster_members": members}, 2)
    broken = {(r["table"], r["rule"]): r["violations"] for r in report.collect() if r["violations"]}
    assert broken == {
        ("tickets", "not_null(ticket_id)"): 1, ("tickets", "not_null(subject)"): 1, ("tickets", "enum(priority)"): 1,
        ("tickets", "dimension(embedding)"): 1, ("tickets", "unique(id)"): 1, ("tickets", "unique(ticket_id)"): 1,
        ("cluster_members", "unique(ticket_id, cluster_id)"): 1, ("cluster_members", "foreign_key(ticket_id -> tickets)"): 2,
        ("cluster_members", "foreign_key(cluster_id -> issue_clusters)"): 1,
    }


@pytest.mark.parametrize("n, limit", [(10, 1000), (90, 1000), (90, 5), (5000, 1000), (0, 1000)])
def test_sample_is_even_and_repeatable(spark, monkeypatch, n, limit):
    """One stratum holds a third of the rows; both rank plans give the same sample."""
    monkeypatch.setattr(sampling, "GROUP_LIMIT", limit)
    df = spark.range(900).selectExpr("id", "case when id < 300 then 'hot' else concat('s', id % 8) end as s")
    got = sampling.stratified_sample(df, "s", "id", n)
    ids = sorted(r["id"] for r in got.collect())
    assert len(ids) == len(set(ids)) == min(n, 900)
    assert ids == sorted(r["id"] for r in sampling.stratified_sample(df.repartition(3), "s", "id", n).collect())
    if n in (10, 90):
        counts = [r["count"] for r in got.groupBy("s").count().collect()]
        assert max(counts) - min(counts) <= 1


def test_sample_with_as_many_strata_as_rows_takes_the_least_hashes(spark):
    for strata, n in (("id", 300), ("id div 2", 700), ("id div 2", 450)):
        df = spark.range(900).selectExpr("id", f"cast({strata} as string) as s")
        got = sampling.stratified_sample(df, "s", "id", n)
        hashes = {i: hashlib.md5(f"42|{i}".encode()).hexdigest() for i in range(900)}
        groups = {}
        for i in sorted(hashes, key=hashes.get):
            groups.setdefault(i if strata == "id" else i // 2, []).append(i)
        rounds = sorted((place, hashes[i], i) for ids in groups.values() for place, i in enumerate(ids))
        per = n // len(groups) + 1
        assert sorted(r["id"] for r in got.collect()) == sorted(i for _, _, i in [x for x in rounds if x[0] < per][:n])
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "TakeOrdered" not in plan
        for below in plan.split("SinglePartition")[1:]:  # only the counts of hash ranges meet, 65,536 at most
            assert "keys=[0#" in below.split("\n")[1] and "_range" in below.split("\n")[1]


def test_rows_without_a_key_are_numbered_in_many_groups(spark):
    df = spark.range(3000).selectExpr("if(id % 3 = 0, null, id) as k", "id as other")
    out = ranking.numbered(df, "k", "n", 10, buckets=64)
    got = out.toPandas()
    assert sorted(got["n"]) == list(range(10, 3010))
    assert got[got["k"].notna()].sort_values("k")["n"].tolist() == list(range(10, 2010))
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, ranking.numbered(df.repartition(5), "k", "n", 10, buckets=64).collect()), key=str)


def test_both_rank_plans_agree(spark, monkeypatch):
    df = spark.range(600).selectExpr("id", "if(id % 3 = 0, 'hot', cast(id % 5 as string)) as s")
    by_window = {r["id"] for r in sampling.stratified_sample(df, "s", "id", 70).collect()}
    monkeypatch.setattr(sampling, "GROUP_LIMIT", 1)
    assert {r["id"] for r in sampling.stratified_sample(df, "s", "id", 70).collect()} == by_window
