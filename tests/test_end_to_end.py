"""A desk from CSV files to the dashboard."""

import csv

import pytest

from trendloom.functions.dates import instant
from trendloom.plans import dashboard, ingest, recluster
from trendloom.sources.store import TicketStore

AS_OF = "2026-03-31T00:00:00Z"
TOPICS = ["mouse wheel stuck", "refund not received", "bluetooth pairing lost", "firmware update failed", "package missing today", "login password reset", "screen flickers badly"]


@pytest.fixture(scope="module")
def desk(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("desk")
    path = root / "a.csv"
    with open(path, "w", newline="") as f:
        out = csv.writer(f)
        out.writerow(["Ticket Subject", "Ticket Description", "Date of Purchase", "Ticket Priority", "Ticket ID"])
        for i in range(140):
            topic = TOPICS[i % 7]
            day = f"2026-0{2 + (i // 7) % 2}-{1 + i % 27:02d}"
            out.writerow([topic, f"{topic} since day {i}", day, "High" if i % 2 else "huge", i])
        out.writerow(["", "", "", "", ""])
        out.writerow([TOPICS[0], "second text of number 0", "2026-03-05", "Low", 0])
    store = TicketStore(spark, str(root / "store"))
    counters = ingest.ingest_csv(spark, store, str(path), instant(AS_OF), dim=128)
    size = recluster.recluster(store, instant(AS_OF), starts=2)
    return store, counters, size, path


def test_counters(desk):
    _, counters, size, _ = desk
    assert counters == {"read": 142, "rejected": 1, "duplicates": 1, "written": 140}
    assert size == 140


def test_second_upload_changes_nothing(spark, desk):
    store, _, _, path = desk
    before = store.read("tickets").select("ticket_id", "created_at", "subject").collect()
    ingest.ingest_csv(spark, store, str(path), instant(AS_OF), dim=128)
    assert sorted(before) == sorted(store.read("tickets").select("ticket_id", "created_at", "subject").collect())


def test_model_is_asked_once_per_ticket_and_a_failure_stores_nothing(spark, desk, tmp_path):
    *_, path = desk
    log, store = tmp_path / "asked", TicketStore(spark, str(tmp_path / "s"))
    log.mkdir()

    def model(texts):
        import uuid

        for _ in texts:
            (log / uuid.uuid4().hex).touch()
        return [[1.0, 0.0] for _ in texts]

    ingest.ingest_csv(spark, store, str(path), instant(AS_OF), model=model)
    assert len(list(log.iterdir())) == store.read("tickets").count() == 140

    def broken(texts):
        raise RuntimeError("no quota")

    store = TicketStore(spark, str(tmp_path / "t"))
    with pytest.raises(Exception, match="no quota"):
        ingest.ingest_csv(spark, store, str(path), instant(AS_OF), model=broken, retries=1)
    assert store.read("tickets").count() == 0
    (failed,) = store.read("job_runs").filter("status = 'failed'").collect()
    assert "no quota" in failed["error_message"]


def test_clusters(desk):
    store, *_ = desk
    clusters = store.read("issue_clusters").collect()
    members = store.read("cluster_members")
    assert 7 >= len(clusters) > 1 or len(clusters) == 11
    assert sum(c["ticket_count"] for c in clusters) == members.count() == 140
    assert members.select("ticket_id").distinct().count() == 140
    assert all(len(c["centroid_embedding"]) == 128 and c["name"] for c in clusters)


def test_listing_and_months(desk):
    store, *_ = desk
    rows = dashboard.get_clusters(store, examples=3).collect()
    assert all(len(r["example_tickets"]) <= 3 for r in rows)
    assert [r["ticket_count"] for r in rows] == sorted((r["ticket_count"] for r in rows), reverse=True)
    march = dashboard.get_clusters(store, "2026-03", 100).collect()
    shown = [t for r in march for t in r["example_tickets"]]
    assert sum(r["ticket_count"] for r in march) == len(shown)
    assert {t["created_at"].month for t in shown} == {3}
    everything = [r["id"] for r in rows]
    assert [r["id"] for r in march] == [i for i in everything if i in {r["id"] for r in march}]
    assert dashboard.get_clusters(store, "2020-01").count() == 0
    assert dashboard.get_clusters_with_tickets(store).count() == 140


def test_search(desk):
    store, *_ = desk
    found = dashboard.similar_tickets(store, "refund not received", 0.3, 500, dim=128).collect()
    assert 0 < len(found) <= 50 and found[0]["subject"] == "refund not received"
    assert [r["similarity"] for r in found] == sorted((r["similarity"] for r in found), reverse=True)
    with pytest.raises(ValueError):
        dashboard.similar_tickets(store, "  ")


def test_summaries_and_alerts(desk):
    store, *_ = desk
    clusters = store.read("issue_clusters").collect()
    assert dashboard.generate_summaries(store).count() == len(clusters)
    assert dashboard.draft_alerts(store).count() == sum(c["trend"] == "Increasing" for c in clusters)


def test_add_and_assign(spark, desk):
    store, *_ = desk
    new = spark.createDataFrame([(i, f"mouse wheel {i}", "broken", "Low", "Bug", "Mouse") for i in range(5)], "at int, subject string, description string, priority string, ticket_type string, product_area string")
    assert ingest.add_tickets(store, new, "at", instant(AS_OF), dim=128) == 5
    assert store.read("tickets").filter("ticket_id like 'TKT-%'").count() == 5
    recluster.assign_new(store, instant(AS_OF))
    assert store.read("cluster_members").count() == 145
    assert sum(r["ticket_count"] for r in store.read("issue_clusters").collect()) == 145
    assert dashboard.tickets_of_source(store, "support").count() == 140


def test_recluster_can_keep_ids(desk):
    store, *_ = desk
    before = {r["id"] for r in store.read("issue_clusters").collect()}
    recluster.recluster(store, instant(AS_OF), keep_ids=True)
    after = {r["id"] for r in store.read("issue_clusters").collect()}
    assert before & after
    store.register_views()
    assert store.spark.sql("select count(*) from cluster_members").first()[0] == 145


def test_too_few_tickets(spark, tmp_path):
    store = TicketStore(spark, str(tmp_path / "s"))
    assert recluster.recluster(store, instant(AS_OF)) == 0
    assert store.read("job_runs").filter("status = 'success'").count() == 1


def test_seed(spark, tmp_path):
    path = tmp_path / "d.csv"
    lines = ["Ticket ID,Ticket Subject,Ticket Description,Ticket Priority,Ticket Type,Product Purchased,Ticket Status"]
    lines += [f"{i},S{i % 4},my {{product_purchased}} {i},Low,Bug,TV,Closed" for i in range(80)]
    path.write_text("\n".join(lines) + "\n")
    store = TicketStore(spark, str(tmp_path / "s"))
    ingest.seed_dataset(spark, store, str(path), instant(AS_OF), 22, dim=32)
    rows = store.read("tickets").collect()
    assert len(rows) == 22 and all(r["description"].startswith("my TV") and r["ticket_id"].startswith("KT-000") for r in rows)
    ingest.seed_dataset(spark, store, str(path), instant(AS_OF), 22, truncate=False, dim=32)
    assert store.read("tickets").count() == 22
