"""The corpus pipeline: language, near-duplicates, benchmark passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; run() writes each result as Parquet in the
shared folder and reads it back as the next one's docs. All but the last return the columns of documents.

Defined results for all stages: rows stand for themselves, so ids may repeat or be null; null in any column is kept as it is
unless a stage says otherwise; further columns, whatever their names, go along up to packing; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vaultloom.llm import decontaminate, dedup, langid, packing, secrets
from vaultloom.llm.common import scratch, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops null texts, texts without a letter, and those to whose best language the model gives less than an even chance
    (calibrated probability below 0.5): strings of ids, shouted junk, a few words between languages.
    """
    return langid.accepted(docs, langid.trained(docs), least=0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group linked by a similarity of 0.8 on five-word shingles.

    Among rows with equal ids the first stays, a null id counts as largest; texts without words are linked with nothing and stay.
    """
    return dedup.deduplicated(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item up to a fifth of its characters edited; null and blank texts and items match nothing."""
    return decontaminate.cleaned(docs, table(spark, sf_dir, "benchmark"))


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps all documents and replaces their secrets; n_chars follows the text where one was replaced, null texts stay null."""
    return secrets.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all texts, with their ids, in windows of 2048; a null text has the end id only."""
    return packing.packed(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("secrets", secret_spans), ("packing", pack)]

#: SQL can't express the model, the tokenizer and the packing; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
