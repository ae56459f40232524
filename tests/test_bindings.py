from pyspark.sql import functions as F

from trendloom.functions import text
from trendloom.sources import bindings as B


def test_tickets_are_counted_by_labels_without_carrying_texts(spark, tmp_path):
    tables = {
        "documents": [
            (1, "Mouse wheel stuck", "en", "s", 1), (1, "Refund please", "en", "s", 1), (2, None, "en", "s", 1), (3, " \n ", "en", "s", 1),
            (3, "no SYNC", "en", "s", 1), (None, None, "en", "s", 1), (None, "Missing package", "en", "s", 1), (5, "İstanbul Crash", "de", "s", 1),
        ],
        "embeddings": [(1, [1.0], 0), (1, [1.0], 0), (3, [1.0], 0), (7, [1.0], 0), (7, None, 0), (None, [1.0], 0), (None, None, 0)],
        "events": [(e, None, 1, "click", 1.0, "") for e in (1, 1, 1, 3, 7, 7, None, 9)],
    }
    for name, rows in tables.items():
        spark.createDataFrame(rows, B.LAYOUTS[name]).write.parquet(f"{tmp_path}/{name}.parquet")
    desk = B.Desk(spark, str(tmp_path))
    body = F.col("description")
    want = desk.tickets().groupBy(text.segment(body).alias("segment"), text.theme(body).alias("theme")).agg(F.count("*").alias("tickets"))
    found = desk.tickets_by(segment=text.segment, theme=text.theme)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and found.columns == want.columns
    assert sum(r["tickets"] for r in found.collect()) == desk.tickets().count() == 24
    dealt = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line]
    assert dealt and not any("text" in line or "_body" in line for line in dealt)


def test_words_of_segments_are_plain():
    from trendloom import fixed_values as V

    assert all(word.isalpha() and word == word.lower() for _, pattern in V.SEGMENTS for word in pattern.split("|"))


def test_no_rule_is_a_regular_expression(spark):
    plan = spark.createDataFrame([("x",)], "n string").select(text.segment(F.col("n")))._jdf.queryExecution().executedPlan().toString()
    assert "RLIKE" not in plan and "Contains" in plan
