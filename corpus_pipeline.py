"""A training corpus from the documents: toxic and near-duplicate texts go, benchmark texts go, secrets are masked, the
rest is encoded.

Every stage takes (spark, docs, folder) and returns a DataFrame; it works on all that the one before it kept. All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.llm import bpe, decontaminate, secrets, simhash, toxicity
from trendloom.llm.common import stored, table
from trendloom.llm.queries import vocabulary_path


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that score below the threshold of the toxicity operator."""
    return toxicity.without_toxic(docs, table(spark, folder, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of every SimHash component."""
    return simhash.keep_one_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold no window of a benchmark text."""
    return decontaminate.clean(docs, table(spark, folder, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, secrets replaced by a mask."""
    return secrets.redacted(docs)


def encode(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents with their token ids (packed, four bytes each), the text that these decode to, and their number."""
    coded = bpe.round_trip(docs, vocabulary_path())
    return coded.withColumn("n_tokens", F.expr("cast(octet_length(bpe_ids) / 4 as bigint)"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("bpe", encode),
]

# Scores and components have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again before the next one."""
    docs = table(spark, folder, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, folder), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, folder)
