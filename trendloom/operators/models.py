"""Steps that call a model: embeddings, cluster names, summaries, alerts.

A model is any function from a list of texts to a list of results. It runs inside the tasks on small batches, with
retries; what still fails is an error in the row and not a failed job. Without a model, deterministic defaults apply.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from string import Formatter

import pandas as pd
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import text
from ..functions.trend import alert_percent, projection
from .ranking import top_per_group

Model = Callable[[list[str]], list]


def call_with_retry(model: Model, texts: list[str], retries: int = V.RETRIES, base_seconds: float = V.RETRY_BASE_SECONDS) -> list:
    for attempt in range(retries):
        try:
            results = model(texts)
            if len(results) != len(texts):
                raise ValueError(f"model gave {len(results)} results for {len(texts)} texts")
            return results
        except Exception:
            if attempt == retries - 1:
                raise
            time.sleep(base_seconds * 2**attempt)
    raise ValueError("retries must be at least 1")


def apply_model(
    rows: DataFrame, text_column: str, model: Model, output: str, output_type: str,
    batch_size: int = V.EMBED_BATCH, retries: int = V.RETRIES, base_seconds: float = V.RETRY_BASE_SECONDS,
) -> DataFrame:
    """The rows with the model's result and ``error``, which is NULL where the call worked.

    Rows without text (NULL) are not sent and get neither.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            texts = frame[text_column].tolist()
            results, errors = [None] * len(texts), [None] * len(texts)
            sent = [i for i, t in enumerate(texts) if t is not None]
            for start in range(0, len(sent), batch_size):
                now = sent[start : start + batch_size]
                try:
                    answers = call_with_retry(model, [texts[i] for i in now], retries, base_seconds)
                    for i, answer in zip(now, answers):
                        results[i] = answer
                except Exception as failure:
                    for i in now:
                        errors[i] = f"batch of {len(now)} failed: {failure}"
            columns = {output: results, "error": errors}
            yield frame.assign(**{name: pd.Series(values, frame.index, object) for name, values in columns.items()})

    kept = [c for c in rows.columns if c not in (output, "error")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept).schema.fields)
    return rows.select(*kept).mapInPandas(run, f"{schema}, `{output}` {output_type}, error string")


# --- embeddings ---------------------------------------------------------------------------------------------------


def embed_texts(rows: DataFrame, text_column: str, model: Model | None = None, dim: int = 256, **options) -> DataFrame:
    """Adds ``embedding`` and ``error``; without a model, hashed word counts of unit length (also on streams)."""
    if model is not None:
        return apply_model(rows, text_column, model, "embedding", "array<float>", **options)
    hashed = _word_counts(rows, text_column, dim)
    unit = Normalizer(inputCol="_tf", outputCol="_unit").transform(hashed)
    vector = vector_to_array("_unit", "float32").alias("embedding")
    return unit.select(*[c for c in rows.columns if c != "embedding"], vector, F.lit(None).cast("string").alias("error"))


def embed_all(rows: DataFrame, text_column: str, model: Model | None = None, **options) -> DataFrame:
    """``embed_texts`` for batches that are stored whole or not at all: a call that fails for good fails the job."""
    embedded = embed_texts(rows, text_column, model, **options)
    failed = F.raise_error(F.concat(F.lit("Embedding failed: "), F.col("error"))).cast("array<float>")
    checked = F.when(F.col("error").isNull(), F.col("embedding")).otherwise(failed)
    return embedded.withColumn("embedding", checked).drop("error", text_column)


def embed_texts_weighted(rows: DataFrame, text_column: str, dim: int = 1024) -> DataFrame:
    """Adds ``embedding``: hashed words weighted by rarity over all rows, unit length. Takes one extra pass."""
    hashed = _word_counts(rows, text_column, dim)
    weighted = IDF(inputCol="_tf", outputCol="_w").fit(hashed).transform(hashed)
    unit = Normalizer(inputCol="_w", outputCol="_unit").transform(weighted)
    return unit.select(*[c for c in rows.columns if c != "embedding"], vector_to_array("_unit", "float32").alias("embedding"))


def _word_counts(rows: DataFrame, text_column: str, dim: int) -> DataFrame:
    filled = rows.withColumn("_text", F.coalesce(F.col(text_column), F.lit("")))
    words = RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"[^\p{L}\p{N}]+").transform(filled)
    return HashingTF(inputCol="_words", outputCol="_tf", numFeatures=dim).transform(words)


# --- cluster names ------------------------------------------------------------------------------------------------


def _line_list(line: Column) -> Column:
    """The lines of a group in rank order, one per row; groups are already cut to a few rows."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    return F.array_join(F.transform(ordered, lambda x: x["line"]), "\n")


def _filled(template: str, **values: Column) -> Column:
    """The template with each {field} replaced by a column; braces inside the values are left alone."""
    parts = []
    for literal, field, _, _ in Formatter().parse(template):
        parts += [F.lit(literal)] if literal else []
        parts += [values[field].cast("string")] if field else []
    return F.concat(*parts)


def name_prompts(subjects: DataFrame) -> DataFrame:
    """(cluster_id, prompt) from ranked subjects."""
    lines = subjects.groupBy("cluster_id").agg(_line_list(F.concat(F.lit("- "), F.col("subject"))).alias("subjects"))
    return lines.select("cluster_id", _filled(V.NAME_PROMPT, subjects=F.col("subjects")).alias("prompt"))


def top_terms(member_subjects: DataFrame, n: int = 3, min_length: int = 3) -> DataFrame:
    """(cluster_id, term, score, rank): the words that set a cluster apart, by frequency in it and rarity elsewhere."""
    words = F.split(F.lower("subject"), r"[^\p{L}\p{N}]+")
    counts = (
        member_subjects.select("cluster_id", F.explode(words).alias("term"))
        .filter(F.length("term") >= min_length)
        .groupBy("cluster_id", "term")
        .agg(F.count("*").alias("tf"))
    )
    spread = counts.groupBy("term").agg(F.count("*").alias("df"))
    clusters = counts.agg(F.count_distinct("cluster_id")).scalar()
    rarity = F.log((clusters + 1) / (F.col("df") + 1)) + 1
    scored = counts.join(spread, "term").select("cluster_id", "term", F.round(F.col("tf") * rarity, 9).alias("score"))
    return top_per_group(scored, ["cluster_id"], [F.col("score").desc(), F.col("term")], n)


def term_names(member_subjects: DataFrame, n: int = 3) -> DataFrame:
    """(cluster_id, name, description) from the top terms."""
    terms = top_terms(member_subjects, n)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"])
    names = terms.groupBy("cluster_id").agg(ordered.alias("terms"))
    return names.select(
        "cluster_id",
        F.initcap(F.array_join("terms", " ")).alias("name"),
        F.concat(F.lit("Tickets about "), F.array_join("terms", ", "), F.lit(".")).alias("description"),
    )


def name_clusters(subjects: DataFrame, model: Model | None = None, member_subjects: DataFrame | None = None) -> DataFrame:
    """(cluster_id, name, description): from the model's JSON answers, or from the top terms without one.

    A failed call or an unreadable answer gives the general name.
    """
    if model is None:
        return term_names(member_subjects if member_subjects is not None else subjects)
    answered = apply_model(name_prompts(subjects), "prompt", model, "answer", "string", batch_size=1)
    parsed = F.from_json("answer", "name string, description string")
    failed = F.col("error").isNotNull() | parsed.isNull()
    fallback = F.when(failed, V.FALLBACK_DESCRIPTION).otherwise("")
    return answered.select(
        "cluster_id",
        F.coalesce(parsed["name"], F.lit(V.FALLBACK_NAME)).alias("name"),
        F.coalesce(parsed["description"], fallback).alias("description"),
    )


# --- summaries and alerts -----------------------------------------------------------------------------------------


def summaries(clusters: DataFrame, subjects: DataFrame, model: Model | None = None, n: int = V.SUMMARY_SUBJECTS) -> DataFrame:
    """(cluster_id, name, prompt, summary, mock): root cause per cluster; the theme's text where no model answers."""
    few = subjects.filter(F.col("rank") <= n)
    lines = few.groupBy("cluster_id").agg(_line_list(F.concat(F.lit("• "), F.col("subject"))).alias("subjects"))
    named = clusters.select(F.col("id").alias("cluster_id"), "name").join(lines, "cluster_id", "left")
    tickets = F.coalesce("subjects", F.lit(""))
    prompts = named.select("cluster_id", "name", _filled(V.SUMMARY_PROMPT, subjects=tickets, name=F.col("name")).alias("prompt"))
    return _answered(prompts, model, text.theme_summary(F.col("name")), "summary", V.SUMMARY_SYSTEM)


def alerts(
    clusters: DataFrame, subjects: DataFrame, model: Model | None = None, platform: str = V.ALERT_PLATFORM,
    n: int = V.ALERT_SUBJECTS, company: str = V.ALERT_COMPANY,
) -> DataFrame:
    """(cluster_id, name, prev, curr, pct, projected, prompt, email, mock) for every increasing cluster.

    ``company`` and ``platform`` name the sender to the model and in the mail.
    """
    few = subjects.filter(F.col("rank") <= n)
    priority = F.coalesce(F.col("priority"), F.lit(V.DEFAULT_PRIORITY))
    line = F.concat(F.lit("• ["), priority, F.lit("] "), F.col("subject"))
    lines = few.groupBy("cluster_id").agg(_line_list(line).alias("subjects"))
    rising = clusters.filter(F.col("trend") == "Increasing")
    prev, curr = F.col("prev_window_count"), F.col("curr_window_count")
    facts = rising.join(lines, F.col("id") == F.col("cluster_id"), "left").select(
        F.col("id").alias("cluster_id"), "name", prev.alias("prev"), curr.alias("curr"),
        alert_percent(prev, curr).alias("pct"), projection(curr).alias("projected"),
        F.coalesce("subjects", F.lit("")).alias("subjects"),
    )
    shared = {"prev": F.col("prev"), "curr": F.col("curr"), "pct": F.col("pct")}
    prompt = _filled(V.ALERT_PROMPT, **shared, name=F.col("name"), subjects=F.col("subjects"))
    mail = _filled(
        V.ALERT_TEMPLATE, **shared, projected=F.col("projected"), rule=F.lit(V.ALERT_RULE), platform=F.lit(platform),
        name=F.col("name"),
    )
    rows = facts.select("cluster_id", "name", "prev", "curr", "pct", "projected", prompt.alias("prompt"), mail.alias("_mail"))
    system = V.ALERT_SYSTEM.format(company=company, platform=platform)
    return _answered(rows, model, F.col("_mail"), "email", system).drop("_mail")


def _answered(rows: DataFrame, model: Model | None, fallback: Column, output: str, system: str) -> DataFrame:
    """The model reads the system instruction, an empty line and the prompt of a row."""
    if model is None:
        return rows.withColumns({output: fallback, "mock": F.lit(True)})
    told = rows.withColumn("_told", F.concat(F.lit(system + "\n\n"), F.col("prompt")))
    asked = apply_model(told, "_told", model, output, "string", batch_size=1).drop("_told")
    answer = F.nullif(text.clean(F.col(output)), F.lit(""))
    return asked.withColumns({output: F.coalesce(answer, fallback), "mock": F.col("error").isNotNull()}).drop("error")
