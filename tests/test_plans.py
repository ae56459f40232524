"""What the plans must not contain, and what they must."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from trendloom.operators import listing, ranking, trends
from trendloom.plans.queries import QUERIES
from trendloom.sources.store import TicketStore

FOLDER = "/root/testdata/sf0.001"
LAZY = sorted(n for n in QUERIES if not n.startswith(("stream", "recluster", "kmeans")))


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_joins(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["dedupe_hot", "dedupe_last", "unique_subjects", "latest_jobs", "similar_topk", "upsert_tickets"])
def test_hot_groups_are_cut_before_the_shuffle(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_window_bounds_and_columns_reach_the_scan(spark, tmp_path):
    df = spark.range(100).selectExpr("cast(id as string) as id", "timestamp'2026-01-01' as created_at", "'x' as description", "array(1.0) as embedding")
    df.write.parquet(f"{tmp_path}/t")
    tickets = spark.read.parquet(f"{tmp_path}/t")
    members = tickets.selectExpr("id as ticket_id", "'c' as cluster_id")
    text = plan(trends.member_windows(members, tickets, rule="month", month="2026-01"))
    assert "GreaterThanOrEqual(created_at,2025-12-01" in text and "< 2026-02-01 00:00:00)" in text
    assert "embedding" not in text and "description" not in text


def test_texts_are_not_shuffled_for_examples(spark, tmp_path):
    spark.range(100).selectExpr(
        "cast(id as string) as id", "cast(id as string) as ticket_id", "'s' as subject", "repeat('x', 100) as description", "'Low' as priority",
        "'p' as product_area", "timestamp'2026-01-01' as created_at",
    ).write.parquet(f"{tmp_path}/t")
    tickets = spark.read.parquet(f"{tmp_path}/t")
    members = tickets.selectExpr("id as ticket_id", "'c' as cluster_id", "1.0D as similarity_score")
    top = listing.top_subjects(members, tickets, 6)
    assert "BroadcastHashJoin" in plan(top) and "Exchange hashpartitioning" not in plan(top)
    assert top.count() == 6


def test_ranks_beyond_the_group_limit(spark):
    rows = spark.range(9000).selectExpr("id", "if(id < 6000, 'hot', 'cold') as g")
    top = ranking.top_per_group(rows, ["g"], [F.col("id").desc()], 2000)
    got = {(r["g"], r["id"], r["rank"]) for r in top.collect()}
    assert got == {("hot", 5999 - i, i + 1) for i in range(2000)} | {("cold", 8999 - i, i + 1) for i in range(2000)}


def test_building_a_query_runs_no_job(spark, tmp_path):
    spark.range(5).selectExpr(
        "cast(id as string) as id", "cast(id as string) as ticket_id", "'s' as subject", "'x' as description", "'Low' as priority",
        "'p' as product_area", "timestamp'2026-01-01' as created_at",
    ).write.parquet(f"{tmp_path}/t")
    tickets = spark.read.parquet(f"{tmp_path}/t")
    members = tickets.selectExpr("id as ticket_id", "'c' as cluster_id", "1.0D as similarity_score")
    tracker, group = spark.sparkContext.statusTracker(), "building"
    spark.sparkContext.setJobGroup(group, group)
    try:
        listing.top_subjects(members, tickets, 6)
        assert list(tracker.getJobIdsForGroup(group)) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_bucketed_copies_join_without_a_shuffle(spark, tmp_path):
    store = TicketStore(spark, str(tmp_path))
    tickets = spark.range(200).selectExpr("cast(id as string) as id", "cast(id as string) as ticket_id", "timestamp'2026-01-15' as created_at")
    store.replace("tickets", tickets)
    store.replace("cluster_members", tickets.selectExpr("id as ticket_id", "if(id < 70, 'hot', id) as cluster_id"))
    t = store.save_bucketed("tickets", "id", "bucketed_tickets", 4, "id", "created_at")
    m = store.save_bucketed("cluster_members", "ticket_id", "bucketed_members", 4, "ticket_id", "cluster_id")
    counts = trends.member_windows(m.hint("merge"), t, rule="month", month="2026-01")
    assert plan(counts).count("Exchange") == 1 and "SortMergeJoin" in plan(counts)  # only the counts are shuffled
    assert {r["cluster_id"]: r["curr_window_count"] for r in counts.collect()}["hot"] == 70
