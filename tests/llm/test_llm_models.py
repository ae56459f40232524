"""Fitted operators: held-out accuracy, planted cases, odd rows; and the pipeline."""

import zlib

import duckdb
import numpy as np
import pytest
from conftest import FOLDER
from pyspark.sql import functions as F

from trendloom.llm import html_extract, logistic, quality_model, toxicity
from trendloom.llm.common import held_out, row_key

LARGE = "/root/testdata/sf0.1"


def read(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def test_held_out_rows_are_those_of_the_checksum(spark):
    rows = spark.range(50).withColumn("h", held_out("id")).collect()
    assert [r.h for r in rows] == [zlib.crc32(str(r.id).encode()) % 4 == 2 for r in rows]


def test_row_keys_tell_null_from_empty(spark):
    rows = spark.createDataFrame([("a", None), ("a", ""), (None, "a"), ("a", "b"), ("ab", "")], "x string, y string")
    assert rows.select(row_key("x", "y")).distinct().count() == 5


def test_lasso_drops_what_says_nothing():
    rng = np.random.default_rng(0)
    table = rng.integers(0, 2, size=(800, 6)).astype(float)
    labels = (table[:, 0] + table[:, 1] > 1).astype(float)
    weights, _ = logistic.fit(table, labels, l1=0.02, rounds=800)
    assert weights[0] > 0.5 and weights[1] > 0.5 and np.abs(weights[2:]).max() < 0.1


def test_rules_compile_to_what_they_say(spark):
    rng = np.random.default_rng(1)
    matrix = rng.random((300, len(quality_model.STATISTICS)))
    labels = ((matrix[:, 0] > 0.4) & (matrix[:, 3] <= 0.7)).astype(float)
    model = quality_model.fit(matrix, labels)
    names = [f"s_{s}" for s in quality_model.STATISTICS]
    frame = spark.createDataFrame(matrix.tolist(), names).withColumn("score", model.score()).toPandas()
    total = np.full(len(frame), model.intercept)
    table = frame[names].to_numpy()
    for rule, weight in zip(model.rules, model.weights, strict=True):
        total += weight * np.logical_and.reduce([c.holds(table) for c in rule])
    assert np.allclose(frame["score"], logistic.sigmoid(total))
    assert ((frame["score"] > 0.5) == (labels == 1)).mean() > 0.97


@pytest.mark.parametrize("name, operator, least", [("quality", quality_model, 0.97), ("toxic", toxicity, 0.95)])
def test_held_out_accuracy(spark, name, operator, least):
    labels = read(spark, LARGE, "labels")
    out = operator.scored(read(spark, LARGE, "documents"), labels)
    known = out.join(labels.select("doc_id", F.col(name).alias("truth")), "doc_id").filter("held_out").toPandas()
    assert len(known) > 500 and (known["predicted"] == known["truth"]).mean() > least
    assert known["score"].between(0, 1).all()


@pytest.mark.parametrize("operator", [quality_model, toxicity])
def test_scores_of_odd_rows(docs, texts, no_docs, spark, operator):
    labels = read(spark, FOLDER, "labels").withColumn("score", F.lit("x"))
    out = operator.scored(docs, labels).collect()
    assert len(out) == len(texts) and all(0 <= r.score <= 1 for r in out)
    assert {r.score for r in out if r.doc_id == 9001} == {r.score for r in out if r.doc_id == 9002}
    assert len({r.score for r in out if r.doc_id == 9004}) == 1
    assert operator.scored(no_docs, labels).collect() == []
    none = labels.limit(0)
    assert {r.score for r in operator.scored(docs, none).collect()} == {0.5}


def test_labels_of_held_out_rows_are_never_read(spark):
    labels, docs = read(spark, FOLDER, "labels"), read(spark, FOLDER, "documents")
    turned = labels.withColumn("quality", F.when(held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted((r.doc_id, r.score) for r in quality_model.scored(docs, x).collect()) for x in (labels, turned))
    assert a == b


@pytest.fixture(scope="module")
def reader(spark):
    counts = toxicity.trigram_counts(read(spark, "/root/testdata/sf0.01", "documents").select(F.lower("text").alias("text")), "text")
    extra = toxicity.classes_of("  idiot moron stupid trash pathetic loser " * 200)
    runs = (extra[:-2] * toxicity.CLASSES + extra[1:-1]) * toxicity.CLASSES + extra[2:]
    counts += np.bincount(runs, minlength=toxicity.CLASSES**3)
    return toxicity.Reader(toxicity.character_costs(counts).tolist())


@pytest.mark.parametrize(
    "typed, meant",
    [("1d10t", "idiot"), ("m0r0n", "moron"), ("stuuuuupid", "stupid"), ("tr@sh", "trash"), ("lo$er", "loser"), ("st.up.id", "stupid"), ("i d i o t", "idiot")],
)
def test_obfuscated_words_are_restored(reader, typed, meant):
    assert meant in reader.words(f"so {typed}, there")


@pytest.mark.parametrize(
    "typed, meant",
    [("!diot", "idiot"), ("(!diot!)", "idiot"), ("moron!", "moron"), ("shi+", "shit"), ("a s t u p i d", "stupid"), ("y o u i d i o t", "idiot"), ("y o u  i d i o t", "idiot")],
)
def test_edge_marks_and_spacing_are_left_to_the_lattice(reader, typed, meant):
    assert meant in reader.words(f"so {typed} there")


def test_numbers_and_punctuation_stay(reader):
    for typed, kept in (("100", "100"), ("10000", "10000"), ("(1)", "1"), ("$100", "$100"), ("!!!", ""), ("...", ""), ("|", "")):
        assert reader.word(typed) == kept


def test_plain_words_stay(reader):
    assert reader.words("The attion, of Größe (and) 2019!") == {"the", "attion", "of", "größe", "and", "2019"}


def test_trigram_counts_cover_all_texts(spark):
    one = spark.createDataFrame([(1, "ab"), (2, None), (3, "ab")], "doc_id long, text string")
    counts = toxicity.trigram_counts(one, "text")
    assert counts.sum() == 3 * 1 + 2 * 2 and counts[(0 * 30 + 1) * 30 + 2] == 2


# Pages


def test_main_text_of_given_pages(spark):
    import html
    import re

    pages = read(spark, "/root/testdata/sf0.01", "pages")
    out = {r.page_id: r for r in html_extract.extract_pages(pages).collect()}
    for page in pages.collect():
        article = re.search(r"<article>(.*)</article>", page.html, re.S)[1]
        text = re.sub(r"</?b>", "", re.sub(r"</?(?:p|br|h1)>", " ", article))
        assert out[page.page_id].text == " ".join(html.unescape(text).split())
        assert out[page.page_id].n_chars == len(out[page.page_id].text)


@pytest.fixture(scope="module")
def page_model(spark):
    pages = read(spark, "/root/testdata/sf0.01", "pages")
    return html_extract.fit(html_extract.training_nodes(pages, "page_id", "html", 150))


PARAGRAPHS = (
    "The first paragraph of the text has <a href=x>a link</a> and goes on for quite a while. It has two sentences.",
    "A second one, with an &amp; and a&nbsp;space, is also rather long, so that it looks like the text that it is.",
    "The third paragraph ends the article, and it says so at some length, as articles do. Then it is over.",
)


@pytest.mark.parametrize("begin, end", [("<article>", "</article>"), ('<div id="main-content">', "</div>"), ("<main>", "</main>")])
def test_other_frames(page_model, begin, end):
    body = "".join(f"<p>{p}" for p in PARAGRAPHS)
    page = (
        '<html><head><title>T</title><style>x</style></head><body><nav><a href="/">Home</a></nav>'
        f'<div class="wrap"><div class="cookie-notice"><p>We use cookies. Please accept them all.</p></div>{begin}<h1>A title</h1>{body}'
        f'<form><label>Mail</label><input></form><script>x("</p>")</script>{end}<aside><p>Related things stand here. Read more.</p></aside>'
        '<section class="comments"><h3>Comments</h3><p>I liked the article very much. Thanks for it.</p></section></div>'
        "<footer>&copy; 2020 Somebody</footer></body></html>"
    )
    expected = (
        "A title The first paragraph of the text has a link and goes on for quite a while. It has two sentences. "
        "A second one, with an & and a space, is also rather long, so that it looks like the text that it is. " + PARAGRAPHS[2]
    )
    assert html_extract.main_text(page, page_model) == expected


ARTICLE = "".join(f"<p>{p}" for p in PARAGRAPHS)
NAV, FOOT = '<nav><a href="/">Home</a> <a href="/b">About us</a></nav>', "<footer>&copy; 2020 Somebody</footer>"


def text_of(blocks):
    import html
    import re

    return " ".join(html.unescape(re.sub(r"</?a[^>]*>", "", b)).replace("\xa0", " ") for b in blocks)


@pytest.mark.parametrize("begin, end", [("<article>", "</article>"), ("<body>", "</body>"), ("<main>", "</main>")])
def test_names_that_hold_other_words(page_model, begin, end):
    names = "plain blog design-post information platform product-review photo-author printable threads readership learn-more moreover reviewBody"
    for name in names.split():
        page = f'<body>{NAV}{begin}<div class="{name}">{ARTICLE}</div>{end}{FOOT}'
        assert html_extract.main_text(page, page_model) == text_of(PARAGRAPHS), name


@pytest.mark.parametrize(
    "page",
    [
        "<table><tr><td><a href=/a>Menu</a><br><a href=/b>Two</a></td><td>{0}</td></tr></table>",
        "<table><tr><td><ul><li><a href=/a>Menu</a></ul></td><td>{0}</td></tr><tr><td>&copy; 2003 me</td></tr></table>",
        "<div>{0}</div><div>We use cookies. Accept all cookies to go on.</div>",
        "<div>Wir verwenden Cookies. <button>Alle akzeptieren</button></div><div>{0}</div>",
        "<div class=post>{0}</div><div id=comments>" + "<div class=comment><p>I liked this. Great piece of writing indeed!</p></div>" * 20 + "</div>",
        "<article>{0}<form><p>Sign up for our letter. We write once a week.</p></form></article>",
    ],
)
def test_tables_notices_and_comments(page_model, page):
    assert html_extract.main_text(f"<body>{NAV}{page.format(ARTICLE)}{FOOT}", page_model) == text_of(PARAGRAPHS)


# Frames of other sites than the model learns from, as (begin, end) of the main text, and parts that are none.
SITES = (
    ('<div id="page"><div class="row"><div class="col-8">', "</div></div></div>"),
    ('<main role="main"><div class="rich">', "</div></main>"),
    ('<div class="story-wrap"><div class="inner">', "</div></div>"),
    ("<section><section>", "</section></section>"),
    ('<table class="layout"><tbody><tr><td>', "</td></tr></tbody></table>"),
)
OTHERS = (
    '<div role="navigation"><a href="/a">{0}</a> | <a href="/b">{1}</a></div>',
    '<div class="top-nav"><ul><li><a href="/a">{0}</a><li><a href="/b">{1}</a></ul></div>',
    '<div class="gdpr-overlay"><p>{0}</p><p>{1}</p></div>',
    '<aside><div><p>{0}</p></div><div>{1}</div></aside>',
    '<div class="reader-comments"><div><b>{0}</b><p>{1}</p></div></div>',
    '<div class="widget"><h4>{0}</h4><p>{1}</p></div>',
    '<div class="site-footer"><p>{0}</p><p>{1}</p></div>',
    '<form action="/s"><p>{0}</p><input name=q><button>{1}</button></form>',
    '<div class="sponsored"><p>{0}</p></div>',
)


def test_blocks_of_held_out_frames(page_model):
    from html import escape

    rng = np.random.default_rng(11)
    texts = [t for (t,) in duckdb.connect().execute("SELECT text FROM '/root/testdata/sf0.01/documents.parquet' ORDER BY doc_id LIMIT 300").fetchall()]
    hit = found = true = 0
    for _ in range(200):
        main = [" ".join(texts[i].split())[: rng.integers(60, 400)].strip() for i in rng.integers(0, len(texts), size=rng.integers(2, 6))]
        other = [f"{k} " + " ".join(texts[i].split())[: rng.integers(15, 90)].strip() for k, i in enumerate(rng.integers(0, len(texts), size=8))]
        begin, end = SITES[rng.integers(len(SITES))]
        parts = [OTHERS[rng.integers(len(OTHERS))].format(escape(other[2 * i]), escape(other[2 * i + 1])) for i in range(4)]
        body = "".join(f"<p>{escape(x)}</p>" for x in main)
        got = html_extract.main_text(f"<body>{parts[0]}{parts[1]}{begin}{body}{parts[2]}{end}{parts[3]}</body>", page_model)
        hit += sum(x in got for x in main)
        true += len(main)
        found += sum(x in got for x in main) + sum(x in got for x in other)
    f1 = 2 * hit / (found + true)
    print("block F1", f1)
    assert f1 >= 0.95


def test_sum_product_gives_the_marginals(page_model):
    nodes = html_extract.Dom('<body><article><p>Some text here.</p><div class="ad">Buy</div></article><footer>x</footer>').nodes
    n = len(nodes)
    total, sums = 0.0, np.zeros(n)
    for code in range(1 << n):
        labels = [code >> i & 1 for i in range(n)]
        weight = 1.0
        for i, node in enumerate(nodes):
            logit = sum(page_model.weights[j] for j in html_extract.features(node))
            weight *= np.exp(logit * labels[i])
            if i:
                kind = html_extract.edge(nodes[node.parent], node)
                weight *= page_model.edges[kind][labels[node.parent]][labels[i]]
        total += weight
        sums += weight * np.array(labels)
    assert np.allclose(page_model.marginals(nodes), sums / total, atol=1e-6)
    parent = np.array([x.parent for x in nodes])
    depth = [0]
    for x in nodes[1:]:
        depth.append(depth[x.parent] + 1)
    levels = [np.flatnonzero(np.array(depth) == d) for d in range(max(depth) + 1)]
    own = np.array([sum(page_model.weights[j] for j in html_extract.features(x)) for x in nodes])
    kinds = np.array([0] + [html_extract.edge(nodes[x.parent], x) for x in nodes[1:]])
    forest, _ = html_extract.forest_marginals(own, np.log(page_model.edges), kinds, parent, levels)
    assert np.allclose(forest[:, 1], sums / total, atol=1e-6)


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p"), (4, "u", "<article>" + "<div>" * 500 + "deep"), (4, "u", "<article>x</article>"), (5, "u", "plain")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    out = html_extract.extract_pages(pages).collect()
    assert len(out) == len(rows) and all(r.text is not None and r.n_chars == len(r.text) for r in out)
    assert html_extract.extract_pages(pages.limit(0)).collect() == []


# Pipeline


def test_pipeline_stages_keep_what_their_operators_keep(spark):
    import brute
    import corpus_pipeline

    folder = "/root/testdata/sf0.01"
    docs = read(spark, folder, "documents")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        docs = stage(spark, docs, folder).cache()
        assert docs.columns == columns
        kept[name] = (before, {r.doc_id: r for r in docs.collect()})
    toxic = {r.doc_id for r in toxicity.scored(read(spark, folder, "documents"), read(spark, folder, "labels")).filter("predicted = 1").collect()}
    before, after = kept["toxicity"]
    assert set(before) - set(after) == toxic and toxic
    before, after = kept["simhash"]
    assert set(after) == {c for _, _, c in brute.simhash_components([(i, r.text) for i, r in before.items()])}
    before, after = kept["decontamination"]
    items = [(r.item_id, r.text) for r in read(spark, folder, "benchmark").collect()]
    assert set(after) == {r[0] for r in brute.contamination([(i, r.text) for i, r in before.items()], items) if not r[5]}
    before, after = kept["secrets"]
    assert set(after) == set(before)
    assert not any(brute.base_secrets(r.text) for r in after.values())
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert len(last) == len(after) and all(r.bpe_text == r.text for r in last)
    assert corpus_pipeline.run(spark, folder).count() == len(after)


def test_queries_are_registered():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names
