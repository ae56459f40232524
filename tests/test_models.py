"""Model calls, names, summaries and alerts."""

import json

import pytest

from trendloom import fixed_values as V
from trendloom.operators import models

CLUSTERS = "id string, name string, trend string, prev_window_count int, curr_window_count int"
SUBJECTS = "cluster_id string, subject string, priority string, rank int"


def test_retry_gives_up_after_the_last_try():
    calls = []

    def flaky(texts):
        calls.append(texts)
        if len(calls) < 3:
            raise RuntimeError("busy")
        return texts

    assert models.call_with_retry(flaky, ["a"], 3, 0) == ["a"]
    with pytest.raises(RuntimeError):
        models.call_with_retry(_busy, ["a"], 2, 0)
    with pytest.raises(ValueError):
        models.call_with_retry(lambda texts: [], ["a"], 1, 0)


def _busy(texts):
    raise RuntimeError("busy")


def test_batches_keep_their_rows_and_failures_stay_in_the_row(spark):
    df = spark.range(250).selectExpr("id", "concat('t', id) as text").coalesce(1)

    def model(texts):
        if "t120" in texts:
            raise RuntimeError("no answer")
        return [[float(t[1:]), float(len(texts))] for t in texts]

    got = models.embed_texts(df, "text", model, batch_size=100, retries=2, base_seconds=0).collect()
    good = [r for r in got if r["error"] is None]
    assert all(r["embedding"][0] == r["id"] for r in good)
    assert {r["embedding"][1] for r in good} <= {100.0, 50.0}
    failed = [r["id"] for r in got if r["error"]]
    assert failed == list(range(100, 200)) and "no answer" in got[150]["error"]


def test_offline_vectors_have_unit_length_and_follow_words(rows):
    df = rows([("a", "Mouse broken!"), ("b", "broken mouse"), ("c", ""), ("d", None)], "id string, text string")
    got = {r["id"]: r["embedding"] for r in models.embed_texts(df, "text", dim=32).collect()}
    assert got["a"] == got["b"] and abs(sum(x * x for x in got["a"]) - 1) < 1e-6
    assert set(got["c"]) == set(got["d"]) == {0.0}
    weighted = {r["id"]: r["embedding"] for r in models.embed_texts_weighted(df, "text", 32).collect()}
    assert weighted["a"] == weighted["b"]


def test_names_from_a_model_and_its_failures(rows):
    subjects = rows([("x", "Mouse dead", "Low", 1), ("x", "Mouse lag", "Low", 2), ("y", "bad", "Low", 1), ("z", "boom", "Low", 1)], SUBJECTS)

    def model(prompts):
        (prompt,) = prompts
        if "boom" in prompt:
            raise RuntimeError("down")
        return [json.dumps({"name": "Mouse", "description": prompt}) if "Mouse" in prompt else "no json"]

    got = {r["cluster_id"]: r for r in models.name_clusters(subjects, model).collect()}
    assert got["x"]["name"] == "Mouse" and "- Mouse dead\n- Mouse lag" in got["x"]["description"]
    assert got["y"]["name"] == V.FALLBACK_NAME
    assert (got["z"]["name"], got["z"]["description"]) == (V.FALLBACK_NAME, V.FALLBACK_DESCRIPTION)


def test_names_from_terms(rows):
    subjects = rows(
        [("x", "Mouse wheel stuck"), ("x", "mouse wheel"), ("x", "Mouse"), ("y", "refund please"), ("y", "refund")], "cluster_id string, subject string"
    )
    got = {r["cluster_id"]: r["name"] for r in models.term_names(subjects, 2).collect()}
    assert got == {"x": "Mouse Wheel", "y": "Refund Please"}


def test_summaries_fall_back_to_the_theme(rows):
    clusters = rows([("x", "Login {subjects}", "Stable", 1, 1), ("y", "Other things", "Stable", 1, 1)], CLUSTERS)
    subjects = rows([("x", f"s{i}", "Low", i) for i in range(1, 13)], SUBJECTS)
    got = {r["cluster_id"]: r for r in models.summaries(clusters, subjects).collect()}
    assert got["x"]["summary"] == V.THEMES[3][2] and got["x"]["mock"]
    assert got["y"]["summary"] == V.OTHER_THEME[1]
    assert "• s10" in got["x"]["prompt"] and "s11" not in got["x"]["prompt"] and "Login {subjects}" in got["x"]["prompt"]
    answered = {r["cluster_id"]: r for r in models.summaries(clusters, subjects, lambda p: [" ok "]).collect()}
    assert answered["x"]["summary"] == "ok" and not answered["x"]["mock"]


def test_alerts_for_increasing_clusters_only(rows):
    clusters = rows([("x", "Webcam", "Increasing", 8, 38), ("n", "New", "Increasing", 0, 3), ("y", "Calm", "Stable", 5, 5)], CLUSTERS)
    subjects = rows([("x", f"s{i}", None if i == 2 else "High", i) for i in range(1, 9)], SUBJECTS)
    got = {r["cluster_id"]: r for r in models.alerts(clusters, subjects).collect()}
    assert set(got) == {"x", "n"}
    assert (got["x"]["pct"], got["x"]["projected"], got["n"]["pct"]) == (375, 49, 100)
    assert "• [High] s1\n• [Medium] s2" in got["x"]["prompt"] and "s7" not in got["x"]["prompt"]
    assert got["x"]["email"].startswith("Subject: [URGENT QA ALERT] 375% Spike Detected — Webcam")
    assert "we project 49 tickets" in got["x"]["email"] and "{" not in got["x"]["email"]


def test_apply_model_types(rows):
    df = rows([(1, "abc")], "id int, text string")
    row = models.apply_model(df, "text", lambda ts: [len(t) for t in ts], "n", "int").first()
    assert (row["id"], row["n"], row["error"]) == (1, 3, None)


def test_models_are_told_their_role(rows):
    clusters = rows(
        [("c", "Name", "Increasing", 1, 2)], "id string, name string, trend string, prev_window_count int, curr_window_count int"
    )
    subjects = rows([("c", 1, "subject", "High")], "cluster_id string, rank int, subject string, priority string")

    def echo(texts):
        return list(texts)

    summary = models.summaries(clusters, subjects, echo).first()
    assert summary["summary"].startswith("You are a senior support analyst") and summary["summary"].endswith(summary["prompt"])
    mail = models.alerts(clusters, subjects, echo, platform="Desk", company="Acme").first()
    assert "at Acme, a D2C" in mail["email"] and "'Desk'" in mail["email"] and mail["email"].endswith(mail["prompt"])
