"""Operators with one right answer, against plain versions."""

import time

import brute
import numpy as np
import pytest
from conftest import FOLDER, given
from pyspark.sql import functions as F

from trendloom.llm import arrays, bpe, decontaminate, quality_rules, secrets, sharding, simhash, suffix_dedup
from trendloom.llm.queries import vocabulary_path


def rows_of(frame, *columns):
    nulls_first = lambda row: tuple((x is not None, x) for x in row)
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=nulls_first)


def same(got, expected):
    nulls_first = lambda row: tuple((x is not None, x) for x in row)
    assert got == sorted(expected, key=nulls_first)


# Secrets


def test_base_secrets_are_those_of_the_patterns(docs, texts):
    got = rows_of(secrets.scan(docs), "doc_id", "n_assign", "n_access", "n_hex", "base_sha256")
    expected = []
    for doc, text in texts:
        spans = brute.base_secrets(text)
        counts = [sum(s[2] == kind for s in spans) for kind in brute.BASE]
        expected.append((doc, *counts, brute.sha(",".join(f"{k}:{a}:{b}" for a, b, k in spans))))
    same(got, expected)
    assert sum(r[1] for r in expected) > 0 and sum(r[2] for r in expected) > 0 and sum(r[3] for r in expected) > 0


def test_entropy_adds_spans_and_the_allow_list_takes_them_back(one_each):
    rows = [
        (1, "q8Zr2LxV0pTn5KcW7mYs3HdB1gFj6AaE"),
        (2, "zzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzz1"),
        (3, "see 123e4567-e89b-12d3-a456-426614174000 there"),
        (4, "an EXAMPLEq8Zr2LxV0pTn5KcW7mYs3HdB1gFj6AaE"),
        (5, "this/is/an/ordinary/path/in/a/folder_with_words"),
        (6, "token=q8Zr2LxV0pTn5KcW7mYs3HdB1gFj6AaE"),
    ]
    spans = dict(rows_of(secrets.scan(one_each(rows)), "doc_id", "spans"))
    assert spans[1] == "entropy_base64:0:32"
    assert [spans[i] for i in (2, 3, 4, 5)] == ["", "", "", ""]
    assert spans[6] == "assign:0:38"


RANDOM = "q8Zr2LxV0pTn5KcW7mYs3HdB1gFj6AaE9uRw4Xk2"


def test_a_secret_is_found_whole_and_its_neighbours_stay(one_each):
    rows = [
        (1, f"my_example_key={RANDOM}"),
        (2, f"see /samples/{RANDOM} there"),
        (3, f"{RANDOM}xxxx{RANDOM}9{RANDOM}"),
        (4, f"key=EXAMPLE{RANDOM}"),
        (5, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
        (6, f"my-sample-key-{RANDOM}"),
        (7, f"my_example_{RANDOM}/etc/{RANDOM}=="),
        (8, "/usr/lib/python3/dist-packages/foo_bar2/some-module_name3/thing"),
        (9, f"q8Zr2LxV0pTn/5KcW7mYs3HdB_1gFj6AaE9uR in {'a' * 30}"),
        (10, "https://host/2024-01-02/reports/123e4567-e89b-12d3-a456-426614174000/Annual_Overview-2023_v2"),
    ]
    spans = dict(rows_of(secrets.scan(one_each(rows)), "doc_id", "spans"))
    assert spans[1] == "entropy_base64:15:55" and spans[2] == "entropy_base64:13:53" and spans[3] == "entropy_base64:0:125"
    assert spans[4] == spans[5] == spans[8] == spans[10] == ""
    assert spans[6] == "entropy_base64:14:54" and spans[7] == "entropy_base64:11:51,entropy_base64:56:98"
    assert spans[9] == "entropy_base64:0:37"
    masked = dict(rows_of(secrets.redacted(one_each(rows)), "doc_id", "text"))
    assert masked[2] == "see /samples/[secret] there" and masked[6] == "my-sample-key-[secret]"
    assert not any(RANDOM[i : i + 6] in masked[r] for r in (1, 2, 3, 6, 7) for i in range(len(RANDOM) - 5))


def entropy(window):
    shares = np.array([window.count(c) for c in set(window)]) / len(window)
    return float(-(shares * np.log2(shares)).sum())


def test_incremental_entropy_is_the_entropy_of_every_window(spark):
    rng = np.random.default_rng(8)
    letters = np.array(list(secrets.BASE64_LETTERS))
    values = ["".join(rng.choice(letters[: rng.integers(8, 40)], rng.integers(24, 90))) for _ in range(400)]
    values.append("aB3" * 6 + RANDOM + "zz" * 14)
    frame = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r.h for r in frame.select(secrets.hot(F.col("v"), secrets.BASE64_LETTERS, 24, 4.0).alias("h")).collect()]
    expected = [any(entropy(v[i : i + 24]) >= 4.0 - 1e-10 for i in range(len(v) - 23)) for v in values]
    assert got == expected and 50 < sum(expected) < 350


def test_windows_across_parts_are_scanned(spark, monkeypatch):
    monkeypatch.setattr(secrets, "PART_LETTERS", 25)
    frame = spark.createDataFrame([("z" * 13 + RANDOM[:24] + "z" * 7,), ("z" * 50,), ("abc",), (RANDOM[:24],)], "v string")
    parts = [r.p for r in frame.select(secrets.overlapping(F.col("v"), 24).alias("p")).collect()]
    assert all(any(v[i : i + 24] in x for x in p) for (v,), p in zip(frame.collect(), parts) for i in range(max(1, len(v) - 23)))


def test_long_candidates_take_time_in_proportion(one_each):
    rng = np.random.default_rng(4)
    letters = np.array(list(secrets.BASE64_LETTERS))
    seconds = []
    for n in (20_000, 200_000, 2_000_000):
        cold = "zy12" * (n // 4)  # no window is hot, so all are scanned
        rows = [(1, "".join(rng.choice(letters, n))), (2, cold + "+"), (3, "/lib_x" * (n // 6))]
        started = time.perf_counter()
        spans = dict(rows_of(secrets.scan(one_each(rows)), "doc_id", "spans"))
        seconds.append(time.perf_counter() - started)
        assert spans[1].startswith("entropy_base64:") and spans[2] == spans[3] == ""
    print(seconds)
    assert seconds[2] - seconds[0] < 20 * max(seconds[1] - seconds[0], 2)


def test_columns_of_the_same_names_stay(spark):
    rows = [(1, "a password=abcdefgh1 b", "own", "own", "own", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, secrets string, base string, entropy string, n_chars long")
    assert [tuple(r) for r in secrets.redacted(docs).collect()] == [(1, "a [secret] b", "own", "own", "own", 12)]


def test_redaction_replaces_spans_and_keeps_the_rest(one_each):
    rows = [(1, "a password=abcdefgh1 b"), (2, None), (3, "plain"), (4, "password=12345678 0123456789abcdef0123456789abcdef")]
    out = dict(rows_of(secrets.redacted(one_each(rows)), "doc_id", "text"))
    assert out == {1: "a [secret] b", 2: None, 3: "plain", 4: "[secret] [secret]"}
    sizes = dict(rows_of(secrets.redacted(one_each(rows)), "doc_id", "n_chars"))
    assert sizes[1] == 12 and sizes[3] == 5


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 1000])
def test_running_sums(spark, n):
    frame = spark.range(1).select(arrays.running_sums(F.array([F.lit(i).cast("long") for i in range(n)]).cast("array<bigint>")).alias("s"))
    assert frame.first().s == [0, *np.cumsum(range(n)).tolist()]


# Suffix arrays


def test_suffix_array_sorts_all_suffixes():
    rng = np.random.default_rng(5)
    for n in (1, 2, 7, 60, 300):
        for letters in (1, 2, 30):
            data = rng.integers(1, letters + 1, size=n)
            assert suffix_array_of(data) == sorted(range(n), key=lambda i: data[i:].tolist())


def suffix_array_of(data):
    return suffix_dedup.suffix_array(data).tolist()


def test_common_prefixes_are_those_of_neighbours():
    rng = np.random.default_rng(6)
    data = np.r_[rng.integers(1, 3, size=200), 0]
    order = suffix_dedup.suffix_array(data)
    got = suffix_dedup.common_prefixes(data, order, np.array([0]), np.array([len(data)]), 9)
    for place in range(1, len(data)):
        a, b = data[order[place - 1] :].tolist(), data[order[place] :].tolist()
        length = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert got[place] == min(length, 9)


def test_segments_hold_every_window_once():
    rng = np.random.default_rng(7)
    pieces = [bytes(rng.integers(97, 100, size=int(n)).astype(np.uint8)) for n in (0, 5, 199, 200, 201, 4000, 0, 900, 0)]
    piece, _, _, start, windows = suffix_dedup.segments(pieces)
    seen = sorted((int(p), int(s) + i) for p, s, w in zip(piece, start, windows, strict=True) for i in range(w))
    assert seen == [(p, i) for p, data in enumerate(pieces) for i in range(max(0, len(data) - 199))]


def removal_of(frame):
    return rows_of(suffix_dedup.removal(frame), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def test_repeated_bytes_go(docs, texts):
    same(removal_of(docs), [(doc, *row) for (doc, _), row in zip(texts, brute.repeated_bytes([t for _, t in texts]), strict=True)])


def test_shards_and_long_texts_change_nothing(one_each, monkeypatch):
    rng = np.random.default_rng(8)
    passage = "".join(rng.choice(list("abcdefgh "), size=330))
    rows = [(i, "".join(rng.choice(list("xyz "), size=90)) + passage + "".join(rng.choice(list("xyz "), size=90))) for i in range(40)]
    rows += [(100, passage * 12), (101, "ab" * 1500)]
    monkeypatch.setattr(suffix_dedup, "SHARD_SEGMENTS", 4)
    monkeypatch.setattr(suffix_dedup, "LOOKUP_WINDOWS", 100)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 700)
    same(removal_of(one_each(rows)), [(d, *row) for (d, _), row in zip(rows, brute.repeated_bytes([t for _, t in rows]), strict=True)])


def test_no_table_stays_in_the_catalog(spark, docs):
    before = {t.name for t in spark.catalog.listTables()}
    changed = suffix_dedup.changed_texts(docs)
    assert {t.name for t in spark.catalog.listTables()} == before and changed.count() > 0


def test_helper_columns_do_not_clash(spark):
    rows = [(1, "a b c d e", "r", "n", "l"), (1, "a b c d e", "r", None, "k"), (2, "another text of words", "r2", "n2", "l2")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, `__row` string, `__copies` string, `__least` string")
    kept = simhash.keep_one_each(frame)
    assert kept.columns == frame.columns
    first, second = sorted(map(tuple, kept.collect()))
    assert first in rows[:2] and second == rows[2]
    assert sorted(map(tuple, simhash.keep_one_each(frame.repartition(5)).collect())) == [first, second]
    benchmark = spark.createDataFrame([(1, "another text of words")], "item_id long, text string")
    clean = decontaminate.clean(frame, benchmark)
    assert clean.columns == frame.columns and sorted(map(str, map(tuple, clean.collect()))) == sorted(map(str, rows[:2]))


# Winnowing


def test_contamination_of_windows_and_short_items(spark, docs, texts):
    body = texts[5][1]
    items = given("benchmark", "item_id, text")
    items += [(500, " ".join(body.split()[3:9])), (501, "one two"), (502, ""), (503, None), (None, body[:200]), (504, "word-less !!"), (504, "one")]
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("row", F.lit(1))
    got = rows_of(decontaminate.contamination(docs, benchmark), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    expected = brute.contamination(texts, items)
    same(got, expected)
    assert sum(r[5] for r in expected) >= 5
    kept = rows_of(decontaminate.clean(docs, benchmark), "doc_id", "text")
    same(kept, [t for t, r in zip(texts, expected, strict=True) if not r[5]])


def test_large_benchmarks_are_joined_without_broadcast(docs, spark, monkeypatch):
    benchmark = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    small = rows_of(decontaminate.contamination(docs, benchmark), "doc_id", "n_hit", "items_sha256")
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert rows_of(decontaminate.contamination(docs, benchmark), "doc_id", "n_hit", "items_sha256") == small


# BPE


def test_ids_and_texts_are_those_of_the_tokenizers_library(docs, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary_path())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    got = rows_of(bpe.digests(docs, vocabulary_path()), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    import hashlib

    expected = []
    for doc, text in texts:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        packed = hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        expected.append((doc, len(ids), packed, brute.sha(tokenizer.decode(ids, skip_special_tokens=False))))
    same(got, expected)


def test_round_trip_on_odd_letters():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary_path())
    rng = np.random.default_rng(3)
    letters = [chr(c) for c in [*range(0x250), 0x1680, 0x2003, 0x2028, 0x300, 0x4E00, 0xFEFF, 0x1F600]]
    texts = ["".join(rng.choice(letters, size=40)) for _ in range(500)] + ["a" * 3000, "ab" * 700]
    vocabulary = bpe.Vocabulary(vocabulary_path())
    packed = vocabulary.encode(texts)
    assert [np.frombuffer(p, dtype="<u4").tolist() for p in packed] == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [vocabulary.decode(p) for p in packed] == texts


# SimHash


def test_components_are_those_of_all_pairs(docs, texts):
    got = rows_of(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id")
    same(got, brute.simhash_components(texts))


def test_small_shards_lose_no_link(spark):
    rng = np.random.default_rng(4)
    centre = int(rng.integers(1 << 62))
    values = {centre ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, size=(300, 2))}
    values |= {int(v) for v in rng.integers(0, 1 << 62, size=100)}
    prints = spark.createDataFrame([(simhash.signed(v),) for v in sorted(values)], "print long")
    links = [(r.a, r.b) for r in simhash.linked(prints, 2, 64).collect()]
    parent = {simhash.signed(v): simhash.signed(v) for v in values}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        assert ((a ^ b) & simhash.ALL_BITS).bit_count() <= 2
        parent[root(a)] = root(b)
    ordered = sorted(values)
    for i, a in enumerate(ordered):
        for b in ordered[:i]:
            if (a ^ b).bit_count() <= 2:
                assert root(simhash.signed(a)) == root(simhash.signed(b))


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (103, 102)], "a long, b long")
    got = dict(rows_of(simhash.components(links), "node", "root"))
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100, 103: 102}


def test_one_row_of_each_component_stays(docs, texts):
    kept = rows_of(simhash.keep_one_each(docs), "doc_id")
    components = {c for _, _, c in brute.simhash_components(texts)}
    same(kept, [(c,) for c in components])
    assert simhash.keep_one_each(docs).columns == docs.columns


# Quality rules


def test_base_counts(docs, texts):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    got = rows_of(quality_rules.judged(docs), "doc_id", *names)
    same(got, [(doc, *(brute.quality_base(text)[n] for n in names)) for doc, text in texts])


def test_lines_go_before_documents(one_each):
    good = "This is a sentence of quite ordinary words, and here is another one that goes on. " * 1
    sentences = "\n".join(f"Line {i} says something else about the thing number {i * 7}, which is fine." for i in range(6))
    rows = [
        (1, sentences + "\nHome | News | Sport | Contact\nAll rights reserved."),
        (2, "\n".join(f"alpha{i} | beta{i} | gamma{i} | delta{i} | epsilon{i}" for i in range(10))),
        (3, good + " ".join(f"w{i}!!" for i in range(40))),
    ]
    out = {r.doc_id: r for r in quality_rules.judged(one_each(rows)).collect()}
    assert out[1].kept and out[1].clean_text == sentences
    assert not out[2].kept and not out[2].base_failed and out[2].clean_text == ""
    assert not out[3].kept


# Sharding


def test_shards_have_equal_bytes_and_gapless_slots(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = sharding.sharded(docs).toPandas()
    assert len(out) == 1000 and set(out["shard"]) == set(range(24)) and set(out["law"]) == {"bytes"}
    assert all(sorted(g) == list(range(len(g))) for _, g in out.groupby("shard")["slot"])
    totals = out.groupby("shard")["size"].sum()
    assert totals.max() - totals.min() <= out["size"].max()
    texts = docs.select("doc_id", F.xxhash64("text").alias("t")).toPandas()
    copies = out.merge(texts, on="doc_id").groupby("t")["shard"].nunique()
    assert copies.max() == 1


def test_shards_of_odd_and_heavy_rows(docs, texts, spark, monkeypatch):
    monkeypatch.setattr(sharding, "FINISH_ROWS", 0)  # histograms go down to single rows
    out = sharding.sharded(docs, shards=5).toPandas()
    assert len(out) == len(texts)
    assert all(sorted(g) == list(range(len(g))) for _, g in out.groupby("shard")["slot"])
    one_text = spark.createDataFrame([(1, "same text")] * 400, "doc_id long, text string")
    heavy = sharding.sharded(one_text, shards=7).toPandas().groupby("shard")["size"].count()
    assert heavy.max() - heavy.min() <= 4 and len(heavy) == 7
    by_size = sharding.sharded(one_text, target_bytes=17 * 100).toPandas()
    assert by_size["shard"].nunique() == 4


def test_copies_of_one_text_stay_off_the_driver(spark, monkeypatch):
    monkeypatch.setattr(sharding, "FINISH_ROWS", 60)
    read, finish = [], sharding.finish

    def counted(points, nodes, slack):
        keep = F.lit(False)
        for node in nodes:
            keep |= sharding.in_range(node)
        read.append(points.filter(keep).count())
        finish(points, nodes, slack)

    monkeypatch.setattr(sharding, "finish", counted)
    rows = [(i, "same text") for i in range(3000)] + [(i, f"{i} other words " * (1 + i % 7)) for i in range(3000, 3900)]
    for docs, shards in ((rows, 24), (rows[:3000], 6)):
        frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
        totals = sharding.sharded(frame, shards=shards).groupBy("shard").agg(F.sum("size").alias("size")).toPandas()["size"]
        assert len(totals) == shards and totals.max() - totals.min() <= 0.1 * totals.mean()
    assert read and max(read) <= 60


def test_points_are_stored_in_few_files(spark):
    docs = spark.createDataFrame([(i, f"text {i % 900}") for i in range(1200)], "doc_id long, text string").repartition(3)
    held = {"spark.sql.shuffle.partitions": "50", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        points = sharding.points_of(docs, "doc_id", "text")
        assert len(points.inputFiles()) <= spark.sparkContext.defaultParallelism and points.count() == 1200
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


# Empty tables


def test_empty_tables_give_no_rows(no_docs, spark):
    benchmark = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    for frame in (
        secrets.scan(no_docs),
        secrets.redacted(no_docs),
        suffix_dedup.removal(no_docs),
        decontaminate.contamination(no_docs, benchmark),
        decontaminate.clean(no_docs, benchmark),
        bpe.digests(no_docs, vocabulary_path()),
        simhash.near_duplicates(no_docs),
        simhash.keep_one_each(no_docs),
        quality_rules.judged(no_docs),
        sharding.sharded(no_docs),
    ):
        assert frame.collect() == []


def test_empty_benchmark_hits_nothing(docs, texts, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.clean(docs, none).count() == len(texts)


@pytest.mark.parametrize("name", ["op2_suffix_dedup", "op4_winnowing", "op8_quality_rules"])
def test_sql_twins(spark, name):
    from tools.compare import difference, duck

    from trendloom.llm.queries import ORACLE_SQL, QUERIES

    expected = duck(FOLDER).execute(ORACLE_SQL[name]).df()
    assert difference(QUERIES[name](spark, FOLDER).toPandas(), expected) is None
