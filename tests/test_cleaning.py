"""CSV dialects, cleaning rules, ids and dates."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from trendloom import fixed_values as V
from trendloom.functions import dates, ids, text
from trendloom.operators import cleaning, ranking
from trendloom.sources import csv_tickets, quoted_csv
from trendloom.sources.csv_tickets import canonical_headers, read_ticket_csv

def as_of():
    return dates.instant("2026-03-11T00:00:00Z")


@pytest.fixture
def csv(spark, tmp_path):
    def read(content, name="t.csv", **options):
        path = tmp_path / name
        path.write_bytes(content if isinstance(content, bytes) else content.encode())
        return read_ticket_csv(spark, str(path), **options)

    return read


def values(df, *columns):
    return [tuple(r) for r in df.orderBy("seq").select(*columns).collect()]


def test_full_dialect(csv):
    content = (
        '﻿Ticket Subject, DESCRIPTION ,Ticket Priority,unknown\r\n'
        '"say ""hi"", now","two\nlines",High,x\r\n'
        'short row\r\n'
        'long,row,Low,x,extra,more\r\n'
        '\r\n'
        '  padded  , text ,,\r\n'
    )
    got = values(csv(content), "subject", "description", "priority", "date")
    assert got == [
        ('say "hi", now', "two\nlines", "High", ""), ("short row", "", "", ""), ("long", "row", "Low", ""),
        ("padded", "text", "", ""),
    ]


@pytest.mark.parametrize("multiline", [True, False])
def test_files_with_another_header_raise_instead_of_swapping_columns(spark, tmp_path, multiline):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("subject,description\ns1,d1\n")
    (tmp_path / "in" / "b.csv").write_text("description,subject\nd2,s2\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_ticket_csv(spark, str(tmp_path / "in"), multiline=multiline).collect()


def test_line_dialect(csv):
    content = 'subject,product area\r\n"a, ""b""",Mouse\r\n\r\n"  c ",\r\n'
    got = values(csv(content, multiline=False, require=("subject",)), "subject", "product_area")
    assert got == [('a, "b"', "Mouse"), ("c", "")]


def test_last_of_two_headers_with_one_meaning_counts(csv):
    assert values(csv("Subject,ticket_subject\nfirst,second\n"), "subject") == [("second",)]


def test_aliases():
    assert canonical_headers(["Ticket ID", " Product Purchased ", "Date of Purchase", '"Ticket Type"', None]) == [
        "raw_ticket_id", "product_area", "date", "ticket_type", "",
    ]


@pytest.mark.parametrize("content", ["", "a,b\n1,2\n"])
def test_missing_columns_are_named(csv, content):
    with pytest.raises(ValueError, match="Columns found: (none|a, b)"):
        csv(content)


def random_csv(rng, rows, end):
    """Text of a file with quotes, commas, blanks and newlines in odd places."""
    fields = [
        "plain", "", " padded ", '"a, b"', f'"two{end}lines"', '"two\r\nlines"', '"say ""hi"""', '"""q"', 'in"side', ' "after blank"', '"x"y',
        f'"{end}{end}, ""{end}"', "é\U0001f600", '""',
    ]
    body = [",".join(rng.choice(fields) for _ in range(rng.choice([1, 3, 3, 3, 4]))) for _ in range(rows)]
    return end.join(["subject,description,ticket priority", *body, rng.choice(["", "last,one,"])])


@pytest.mark.parametrize("seed", range(4))
def test_one_file_with_quoted_newlines_is_read_by_many_tasks(spark, tmp_path, monkeypatch, seed):
    content = random_csv(random.Random(seed), 300, "\r\n" if seed % 2 else "\n")
    if seed > 1:  # a field that is longer than many splits
        content += '\r\n"' + "long\nfield, " * 400 + '",end,\r\nlast,one,'
    (tmp_path / "t.csv").write_bytes(content.encode())
    columns = ("subject", "description", "priority")
    sizes = {"spark.sql.files.maxPartitionBytes": "512", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in sizes}
    for k, v in sizes.items():
        spark.conf.set(k, v)
    try:
        tasks = quoted_csv.lines_of(spark, str(tmp_path / "t.csv")).select(F.spark_partition_id()).distinct().count()
        many = values(read_ticket_csv(spark, str(tmp_path / "t.csv")), *columns)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    monkeypatch.setattr(csv_tickets, "_line_end", lambda *_: "\r")
    one = values(read_ticket_csv(spark, str(tmp_path / "t.csv")), *columns)
    assert tasks >= 8 and len(one) > 200 and many == one


@pytest.mark.parametrize("seed", range(3))
def test_line_states_are_those_of_a_scan_by_letter(seed):
    rng = random.Random(seed)
    for _ in range(3000):
        line = "".join(rng.choice('"", ab') for _ in range(rng.randint(0, 12)))
        for inside in (False, True):
            state, i = "quoted" if inside else "start", 0
            while i < len(line):
                c = line[i]
                if state == "quoted" and c == '"':
                    if line[i + 1 : i + 2] == '"':
                        i += 1
                    else:
                        state = "plain"
                elif state != "quoted" and c == ",":
                    state = "start"
                elif state == "start" and c == '"':
                    state = "quoted"
                elif state == "start" and c != " ":
                    state = "plain"
                i += 1
            assert quoted_csv.ends_inside(line, inside) == (state == "quoted"), (line, inside)


def test_bare_carriage_returns_end_lines_too(csv):
    assert values(csv("subject,description\ra,b\rc,d\r"), "subject", "description") == [("a", "b"), ("c", "d")]


def test_header_without_rows(csv):
    assert csv("subject\n").count() == 0


def test_clean_rows(rows):
    long, short = "x" * 81, "y" * 80
    raw = rows(
        [
            (1, "", long, "high", "", "", "", "junk"), (2, "", short, "Urgent", "Bug", "Mouse", "77", "2026-02-30"),
            (3, " s ", "", "Critical", None, None, None, "2026-01-05"), (4, " ", " ", "", "", "", "", ""),
        ],
        "seq int, subject string, description string, priority string, ticket_type string, product_area string, raw_ticket_id string, date string",
    )
    kept = cleaning.with_text(raw)
    got = cleaning.clean_tickets(kept, as_of()).orderBy("seq").collect()
    assert [r["subject"] for r in got] == ["x" * 80 + "...", short, "s"]
    assert [r["description"] for r in got] == [long, short, "s"]
    assert [r["priority"] for r in got] == ["Medium", "Medium", "Critical"]
    assert [r["ticket_type"] for r in got] == ["Support Request", "Bug", "Support Request"]
    assert [r["product_area"] for r in got] == ["General", "Mouse", "General"]
    assert [r["dated"] for r in got] == [False, False, True]
    assert [str(r["created_at"].date()) for r in got] == ["2026-03-11", "2026-03-11", "2026-01-05"]
    assert got[1]["ticket_id"] == "CSV-" + hashlib.md5(b"77").hexdigest()[:16]
    assert got[2]["ticket_id"] == "CSV-" + hashlib.md5(b"s|s").hexdigest()[:16]
    assert [r["seq"] for r in cleaning.rejected(raw).collect()] == [4]
    assert cleaning.with_text(raw, "subject").count() == 1


def test_same_ticket_in_two_months_has_two_ids(rows):
    df = rows([("s", "d", "1")], "s string, d string, r string")
    got = df.select(*[ids.stable_ticket_id(F.col("s"), F.col("d"), r, m) for r in (F.col("r"), None) for m in ("2026-01", "2026-02", None)]).first()
    keys = ["2026-01|1", "2026-02|1", "1", "2026-01|s|d", "2026-02|s|d", "s|d"]
    assert list(got) == ["CSV-" + hashlib.md5(k.encode()).hexdigest()[:16] for k in keys]


def test_month_coercion(rows):
    cases = {
        "2026-03-05": "2026-03-05", " 2026-03-05T10:00:00Z ": "2026-03-05T10:00:00Z", "2026-02-28": None, "junk": None, "": None,
        "2026-03-32": None, "2026-03-31T23:00:00-05:00": "2026-03-31T23:00:00-05:00",
    }
    df = rows([(k,) for k in cases], "d string").select("d", dates.coerce_to_month(F.col("d"), "2026-03").alias("m"))
    assert {r["d"]: r["m"] for r in df.collect()} == {k: v or "2026-03-01T00:00:00+00:00" for k, v in cases.items()}


def test_date_near_a_month_end_keeps_its_text_but_not_its_utc_month(rows):
    moved = dates.parse_date(dates.coerce_to_month(F.col("d"), "2026-03"))
    df = rows([("2026-03-31T23:00:00-05:00",)], "d string").select(dates.in_month(moved, "2026-03"), dates.in_month(moved, "2026-04"))
    assert tuple(df.first()) == (False, True)


def test_free_form_dates(rows):
    df = rows([("3/9/2026",), ("Mar 9, 2026",), ("9 Mar 2026",), ("2026-03-09T00:00:00",)], "d string")
    got = {r[0] for r in df.select(dates.parse_date(F.col("d")).cast("date").cast("string")).collect()}
    assert got == {"2026-03-09"}


def test_embed_text(rows):
    cases = {
        ("s", "d", "Bug", "Mouse"): "s. d. Type: Bug. Product: Mouse", ("s", "s", "Support Request", "General"): "s",
        ("s", "has {x} inside", "", ""): "s", ("", "has {x}", "", ""): "has {x}", ("s", "only {", "", ""): "s. only {",
    }
    df = rows(list(cases), "s string, d string, t string, p string")
    got = [r[0] for r in df.coalesce(1).select(text.rich_embed_text(*[F.col(c) for c in "sdtp"])).collect()]
    assert got == list(cases.values())
    one = rows([(" s ", "")], "s string, d string").select(text.simple_embed_text(F.col("s"), F.col("d"))).first()[0]
    assert one == "s."


def test_padded_ids(rows):
    df = rows([("7",), ("12345",), ("1234567",)], "i string").select(ids.padded_ticket_id(F.col("i")))
    assert [r[0] for r in df.collect()] == ["KT-00007", "KT-12345", "KT-1234567"]


def test_next_numbers(rows, spark):
    existing = rows([("TKT-2004",), ("TKT-x",), ("CSV-9",), ("TKT-7",)], "ticket_id string")
    incoming = spark.range(500).selectExpr("id * 3 as at", "id as k").repartition(7, "k")
    got = cleaning.next_numbered_ids(existing, incoming, "at").orderBy("at").collect()
    assert [r["ticket_id"] for r in got] == [f"TKT-{2005 + i}" for i in range(500)]
    without_key = incoming.limit(1).unionByName(incoming.limit(1).withColumn("at", F.lit(None).cast(incoming.schema["at"].dataType)))
    numbers = {r["ticket_id"] for r in cleaning.next_numbered_ids(existing.filter("false"), without_key, "at").collect()}
    assert numbers == {"TKT-2000", "TKT-2001"}
    first = cleaning.next_numbered_ids(existing.filter("false"), incoming.limit(1), "at").first()
    assert first["ticket_id"] == "TKT-2000"


def test_dedupe_keeps_the_last(rows):
    df = rows([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), ("b", 1, "w")], "ticket_id string, seq int, v string")
    assert {(r["ticket_id"], r["v"]) for r in ranking.last_per_id(df).collect()} == {("a", "z"), ("b", "w")}


def test_dataset_tickets(rows):
    raw = rows(
        [("42", "Refund", "My {product_purchased} broke, {product_purchased}!", "Low", "Refund request", "TV", "Closed", "2021-03-22"),
         ("43", "Help", "text", "Low", "x", "TV", "Pending Customer Response", "")],
        "raw_ticket_id string, subject string, description string, priority string, ticket_type string, product_area string, status string, date string",
    )
    got = cleaning.dataset_tickets(raw, as_of()).orderBy("ticket_id").collect()
    assert (got[0]["ticket_id"], got[0]["description"], got[0]["status"]) == ("KT-00042", "My TV broke, TV!", "Closed")
    assert (got[1]["status"], got[1]["created_at"].year, got[0]["created_at"].year) == ("Open", 2026, 2021)


def test_segments_and_themes(rows):
    names = {
        "Bluetooth Mouse": ("Connectivity", "other"), "MOUSE wheel": ("Hardware", "other"), "Firmware update": ("Software", "other"),
        "Missing parcels": ("Delivery", "data"), "Refund": ("Returns", "billing"), "App Crash On Start": ("Software", "setup"), "": ("Other", "other"),
    }
    df = rows([(n,) for n in names], "n string").select("n", text.segment(F.col("n")).alias("s"), text.theme(F.col("n")).alias("t"))
    assert {r["n"]: (r["s"], r["t"]) for r in df.collect()} == names
    assert len(V.THEMES) == 7
