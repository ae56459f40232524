"""Registered queries of the subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trendloom.llm import (
    bpe, decontaminate, fill_middle, html_extract, lexical_search, neighbours, quality_model, quality_rules, secrets, sharding, simhash,
    suffix_dedup, toxicity,
)
from trendloom.llm.common import table
from trendloom.llm.sql import ORACLE_SQL


__all__ = ["ORACLE_SQL", "QUERIES"]


def vocabulary_path() -> str:
    """The public byte-level vocabulary, at the same place on every machine."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.scan(table(spark, folder, "documents"))


def op2_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.removal(table(spark, folder, "documents"))


def op3_rule_ensemble(spark: SparkSession, folder: str) -> DataFrame:
    return quality_model.scored(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op4_winnowing(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op5_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(table(spark, folder, "documents"), vocabulary_path())


def op6_kd_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.sharded(table(spark, folder, "documents"))


def op7_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judged(table(spark, folder, "documents")).drop("clean_text")


def op9_dom_model(spark: SparkSession, folder: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, folder, "pages"))


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.scored(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op11_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(table(spark, folder, "embeddings"), every=20)


def op12_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    return fill_middle.round_trips(table(spark, folder, "documents"))


def op13_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline  # it takes its operators from here

    return corpus_pipeline.run(spark, folder)


QUERIES = {
    "op1_secrets": op1_secrets,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_rule_ensemble": op3_rule_ensemble,
    "op4_winnowing": op4_winnowing,
    "op5_bpe": op5_bpe,
    "op6_kd_sharding": op6_kd_sharding,
    "op7_simhash": op7_simhash,
    "op8_quality_rules": op8_quality_rules,
    "op9_dom_model": op9_dom_model,
    "op10_toxicity": op10_toxicity,
    "op11_neighbours": op11_neighbours,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_lexical_search": op13_lexical_search,
    "pipeline": pipeline,
}
