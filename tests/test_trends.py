"""Trend labels, windows and months at their boundaries."""

from datetime import datetime, timedelta, timezone

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trendloom.functions import dates, trend
from trendloom.operators import trends

NOW = datetime(2026, 3, 11, 12, 0, tzinfo=timezone.utc)
AS_OF = dates.instant


@pytest.mark.parametrize(
    "prev, curr, label, text, alert",
    [
        (0, 0, "Stable", "—", 100), (0, 1, "Increasing", "+100%", 100), (4, 5, "Stable", "+25%", 25),
        (4, 3, "Stable", "-25%", -25), (100, 126, "Increasing", "+26%", 26), (100, 74, "Decreasing", "-26%", -26),
        (8, 7, "Stable", "-12%", -12), (8, 9, "Stable", "+13%", 13), (3, 0, "Decreasing", "-100%", -100),
    ],
)
def test_trend_boundaries(rows, prev, curr, label, text, alert):
    p, c = F.col("p"), F.col("c")
    got = rows([(prev, curr)], "p long, c long").select(
        trend.trend_label(p, c), trend.percent_text(p, c), trend.alert_percent(p, c), trend.projection(c)
    ).first()
    assert tuple(got) == (label, text, alert, int(curr * 1.3 + 0.5))


# Designed outcomes: category -> (previous window, current window, label).
DESIGNED = {
    "webcam": (8, 38, "Increasing"), "keyboard": (9, 27, "Increasing"), "software": (20, 22, "Stable"),
    "shipping": (17, 18, "Stable"), "hardware": (22, 11, "Decreasing"), "mouse": (17, 18, "Stable"), "returns": (16, 8, "Decreasing"),
    "network": (4, 11, "Increasing"), "billing": (6, 6, "Stable"), "crashes": (8, 3, "Decreasing"), "login": (3, 8, "Increasing"),
    "sync": (4, 4, "Stable"), "performance": (5, 5, "Stable"), "features": (4, 2, "Decreasing"),
}


@pytest.mark.parametrize("rule", ["rolling", "rolling_closed", "split"])
def test_designed_trends(rows, rule):
    data = []
    for name, (prev, curr, _) in DESIGNED.items():
        days = [31 + i % 28 for i in range(prev)] + [i % 29 for i in range(curr)]
        data += [(f"{name}-{i}", name, NOW - timedelta(days=d)) for i, d in enumerate(days)]
    all_rows = rows(data, "id string, cluster_id string, created_at timestamp")
    members = all_rows.select(F.col("id").alias("ticket_id"), "cluster_id")
    clusters = rows([(n, n) for n in DESIGNED], "id string, name string")
    got = trends.cluster_trends(clusters, members, all_rows, as_of=AS_OF(NOW), rule=rule).collect()
    assert {r["name"]: (r["prev_window_count"], r["curr_window_count"], r["trend"]) for r in got} == DESIGNED
    totals = [r["ticket_count"] for r in got]
    assert totals == sorted(totals, reverse=True)


def test_window_edges(rows):
    stamps = {
        "now": NOW, "future": NOW + timedelta(seconds=1), "d30": NOW - timedelta(days=30),
        "d30+": NOW - timedelta(days=30, seconds=1), "d60": NOW - timedelta(days=60), "d61": NOW - timedelta(days=61),
    }
    data = rows(list(stamps.items()), "k string, ts timestamp")

    def counts(rule):
        got = trends.count_windows(data, "k", "ts", AS_OF(NOW), rule).collect()
        return {r["k"]: (r["prev_window_count"], r["curr_window_count"]) for r in got}

    rolling = {"now": (0, 1), "future": (0, 1), "d30": (0, 1), "d30+": (1, 0), "d60": (1, 0)}
    assert counts("rolling") == rolling
    assert counts("rolling_closed") == {k: v for k, v in rolling.items() if k != "future"}
    assert counts("split") == rolling | {"d61": (1, 0)}
    with pytest.raises(ValueError):
        counts("weekly")


def test_month_ranges_wrap_the_year():
    assert dates.month_start("2026-01", -1) == datetime(2025, 12, 1, tzinfo=timezone.utc)
    assert dates.month_start("2025-12", 1) == datetime(2026, 1, 1, tzinfo=timezone.utc)


def test_month_view_drops_clusters_without_tickets(rows):
    utc = timezone.utc
    tickets = rows(
        [("a", datetime(2026, 1, 1, tzinfo=utc)), ("b", datetime(2025, 12, 31, 23, 59, 59, tzinfo=utc)), ("c", datetime(2026, 2, 1, tzinfo=utc))],
        "id string, created_at timestamp",
    )
    members = rows([("a", "x"), ("b", "x"), ("c", "y")], "ticket_id string, cluster_id string")
    clusters = rows([("x", "X", ""), ("y", "Y", "")], "id string, name string, description string")
    got = trends.month_view(clusters, members, tickets, "2026-01").collect()
    assert [(r["name"], r["ticket_count"], r["prev_window_count"], r["trend"]) for r in got] == [("X", 1, 1, "Stable")]


def test_refresh_zeroes_or_keeps_empty_clusters(rows):
    clusters = rows(
        [("x", "X", 0, 0, 0, "Stable", NOW), ("gone", "G", 9, 4, 5, "Increasing", NOW)],
        "id string, name string, ticket_count int, prev_window_count int, curr_window_count int, trend string, updated_at timestamp",
    )
    tickets = rows([("a", NOW), ("old", NOW - timedelta(days=400))], "id string, created_at timestamp")
    members = rows([("a", "x"), ("old", "x"), ("missing", "x")], "ticket_id string, cluster_id string")

    def fresh(stale):
        got = trends.refresh_trends(clusters, members, tickets, AS_OF(NOW), stale).collect()
        return {r["id"]: (r["ticket_count"], r["prev_window_count"], r["curr_window_count"], r["trend"]) for r in got}

    assert fresh("zero") == {"x": (3, 0, 1, "Increasing"), "gone": (0, 0, 0, "Stable")}
    assert fresh("keep")["gone"] == (9, 4, 5, "Increasing")


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 100)), min_size=1, max_size=40))
def test_rolling_counts_equal_brute_force(spark, data):
    day0 = datetime(2026, 1, 1, tzinfo=timezone.utc)
    df = spark.createDataFrame([(k, day0 + timedelta(days=d)) for k, d in data], "k string, ts timestamp")
    got = trends.rolling_counts(trends.daily_counts(df, "k", "ts"), "k", 30).collect()
    for r in got:
        age = [(r["day"] - (day0 + timedelta(days=d)).date()).days for k, d in data if k == r["k"]]
        assert r["curr_window_count"] == sum(0 <= a < 30 for a in age)
        assert r["prev_window_count"] == sum(30 <= a < 60 for a in age)


def test_ages(rows):
    seconds = [0, 59, 60, 3599, 3600, 86399, 86400, 86400 * 3 + 5]
    df = rows([(i, NOW - timedelta(seconds=s)) for i, s in enumerate(seconds)], "i int, ts timestamp")
    got = [r[0] for r in df.orderBy("i").select(dates.age_text(F.col("ts"), AS_OF(NOW))).collect()]
    assert got == ["just now", "just now", "1m ago", "59m ago", "1h ago", "23h ago", "1d ago", "3d ago"]
