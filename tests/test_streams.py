"""Streams equal the batch operators on the same rows, and replays add nothing."""

import json

import pytest
from pyspark.sql import functions as F

from trendloom.functions.dates import instant
from trendloom.operators import clustering, models, trends
from trendloom.operators.similarity import nearest_centroid
from trendloom.sources.json_tickets import BAD_JSON, MISSING_FIELDS, parse_tickets, read_json_stream
from trendloom.sources.store import TicketStore
from trendloom.streaming import live
from trendloom.streaming import trends as stream_trends

NOW = "2026-03-11T12:00:00Z"
DIM = 32


def payloads():
    good = [{"id": f"G-{i}", "subject": f"mouse wheel {i % 5}" if i % 2 else f"refund order {i % 3}", "priority": "High" if i % 3 else "urgent"} for i in range(40)]
    good += [{"id": "HOT", "subject": "hot"}] * 30
    good[5]["product_area"], good[6]["customer_email"] = "Mouse", "x@example.com"
    bad = ["{oops", '{"id": "", "subject": "s"}', '{"subject": "no id"}', '{"id": "q"}', "[1]"]
    return [json.dumps(g) for g in good], bad


@pytest.fixture
def clusters(rows):
    names = rows([("M", "Mouse", "mouse wheel"), ("R", "Refund", "refund order"), ("E", "Empty", "zzz")], "id string, name string, seed string")
    centroids = models.embed_texts(names, "seed", dim=DIM).select("id", "name", F.col("embedding").cast("array<double>").alias("centroid_embedding"))
    return centroids.selectExpr("*", "10 as ticket_count", "4 as prev_window_count", "4 as curr_window_count", "'Stable' as trend")


def run(spark, clusters, tmp_path, model=None, **options):
    return live.start_live_ingest(
        spark, read_json_stream(spark, f"{tmp_path}/in", 2), clusters, f"{tmp_path}/out", f"{tmp_path}/cp",
        as_of=lambda: instant(NOW), model=model, trigger={"availableNow": True}, dim=DIM,
        **options,
    )


def write(folder, name, lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(lines) + "\n")


def test_parse(rows):
    lines = payloads()[1] + ['{"id": "1", "subject": "s"}']
    got = parse_tickets(rows([(x,) for x in lines], "payload string")).collect()
    assert [r["error"] for r in got] == [BAD_JSON, MISSING_FIELDS, MISSING_FIELDS, MISSING_FIELDS, BAD_JSON, None]


def test_live_ingest(spark, clusters, tmp_path):
    good, bad = payloads()
    for i in range(0, len(good), 20):
        write(tmp_path / "in", f"{i:03d}.json", good[i : i + 20])
    run(spark, clusters, tmp_path).awaitTermination()
    repeats = [json.dumps({"id": f"G-{i}", "subject": "a repeat"}) for i in range(0, 40, 4)]
    write(tmp_path / "in", "999.json", bad + good[:10] + repeats)  # repeats arrive in a later run
    query = run(spark, clusters, tmp_path)
    query.awaitTermination()

    out = f"{tmp_path}/out"
    tickets = live.read_live(spark, out, "tickets")
    got = {r["ticket_id"]: r for r in tickets.collect()}
    assert tickets.count() == len(got) == 41
    assert got["WH-G-5"]["product_area"] == "Mouse" and got["WH-G-1"]["product_area"] == "Mouse" and got["WH-G-2"]["product_area"] == "Refund"
    assert {r["priority"] for r in got.values()} == {"High", "Medium"}
    assert got["WH-HOT"]["description"] == "hot" and got["WH-HOT"]["source"] == "webhook"
    assert str(got["WH-G-1"]["created_at"].year) == "2026"

    members = live.read_live(spark, out, "cluster_members")
    want = nearest_centroid(tickets, clusters)
    assert {tuple(r) for r in members.select("ticket_id", "cluster_id").collect()} == {tuple(r) for r in clustering.membership(want).select("ticket_id", "cluster_id").collect()}

    letters = live.read_live(spark, out, "job_runs").collect()
    assert sorted(r["error_message"].split(" | payload: ")[1] for r in letters) == sorted(bad)
    assert {(r["job_type"], r["status"]) for r in letters} == {("webhook", "failed")}

    shown = {r["ticket_id"]: r for r in live.shown_arrivals(tickets, members, clusters).collect()}
    assert len(shown) == 41 and shown["WH-G-1"]["assigned_cluster"] == "Mouse" and shown["WH-G-1"]["similarity_score"] > 0

    store = TicketStore(spark, f"{tmp_path}/store")
    assert live.fold_into(store, f"{tmp_path}/nothing") == -1
    last = live.fold_into(store, out)
    for after in (-1, last):
        assert live.fold_into(store, out, after) == last
        assert store.read("tickets").count() == store.read("cluster_members").count() == 41
    assert store.read("job_runs").filter("status = 'failed'").count() == len(bad)

    counts = {r["cluster_id"]: r["n"] for r in members.groupBy("cluster_id").agg(F.count("*").alias("n")).collect()}
    now = {r["id"]: r for r in live.live_clusters(clusters, live.read_live(spark, out, "cluster_changes")).collect()}
    for key, row in now.items():
        assert row["ticket_count"] == 10 + counts.get(key, 0)
        assert row["curr_window_count"] == 4 + counts.get(key, 0)
    assert now["M"]["trend"] == "Increasing" and now["E"]["trend"] == "Stable"


def test_a_failed_ticket_is_a_dead_letter_and_may_be_sent_again(spark, clusters, tmp_path):
    flag = tmp_path / "up"

    def model(texts):
        if not flag.exists():
            raise RuntimeError("down")
        return [[1.0] * DIM for _ in texts]

    ticket = [json.dumps({"id": "1", "subject": "boom"})]
    write(tmp_path / "in", "1.json", ticket)
    run(spark, clusters, tmp_path, model, retries=2, base_seconds=0).awaitTermination()
    out = f"{tmp_path}/out"
    assert live.read_live(spark, out, "tickets").count() == 0
    (letter,) = live.read_live(spark, out, "job_runs").collect()
    assert "down" in letter["error_message"] and "boom" in letter["error_message"]
    flag.touch()
    write(tmp_path / "in", "2.json", ticket)
    run(spark, clusters, tmp_path, model, retries=2, base_seconds=0).awaitTermination()
    assert [r["ticket_id"] for r in live.read_live(spark, out, "tickets").collect()] == ["WH-1"]


def test_a_replayed_batch_changes_nothing(spark, clusters, tmp_path):
    write(tmp_path / "in", "1.json", payloads()[0][:8])
    run(spark, clusters, tmp_path).awaitTermination()
    first = sorted(map(tuple, live.read_live(spark, f"{tmp_path}/out", "cluster_members").collect()))
    for name in ("0", ".0.crc"):  # as if the driver was lost before the batch was noted as done
        (tmp_path / "cp" / "commits" / name).unlink(missing_ok=True)
    run(spark, clusters, tmp_path).awaitTermination()
    assert sorted(map(tuple, live.read_live(spark, f"{tmp_path}/out", "cluster_members").collect())) == first and len(first) == 8


def test_ids_stay_taken_without_state(spark, clusters, tmp_path):
    line = lambda i, n: json.dumps({"id": str(i), "subject": f"mouse {n}"})
    write(tmp_path / "in", "1.json", [line(i, n) for n in (2, 1) for i in range(5)])
    run(spark, clusters, tmp_path).awaitTermination()
    write(tmp_path / "in", "2.json", [line(i, 3) for i in range(7)])
    taken = lambda: spark.createDataFrame([("WH-6",)], "ticket_id string")
    query = run(spark, clusters, tmp_path, stored=taken)
    query.awaitTermination()
    got = {r["ticket_id"]: r["subject"] for r in live.read_live(spark, f"{tmp_path}/out", "tickets").collect()}
    assert got == {**{f"WH-{i}": "mouse 1" for i in range(5)}, "WH-5": "mouse 3"}
    assert query.lastProgress["stateOperators"] == []


def test_daily_stream_equals_batch(spark, tmp_path):
    events = spark.range(3000).selectExpr(
        "timestamp'2026-01-01' + make_dt_interval(cast(id % 70 as int), cast(id % 24 as int)) as ts", "if(id % 3 = 0, 'hot', cast(id % 4 as string)) as k"
    )
    events.repartition(6).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    daily = stream_trends.daily_stream(source, "k", "ts", "90 days")
    stream_trends.start_daily_counts(daily, f"{tmp_path}/out", f"{tmp_path}/cp", {"availableNow": True}).awaitTermination()
    stored = spark.read.option("basePath", f"{tmp_path}/out").parquet(f"{tmp_path}/out")
    got = {tuple(r) for r in stream_trends.stream_trends(stored, "k").collect()}
    want = {tuple(r) for r in trends.rolling_counts(trends.daily_counts(events, "k", "ts"), "k").collect()}
    assert got == want and len(got) > 200
