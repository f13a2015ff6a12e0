"""Corpus pipeline: language, exact copies, near copies, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; between stages
rows are written as Parquet. `run` applies them to `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabloom.llm.common import docs_of, stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    from tabloom.llm.langid import accepted

    return accepted(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    from tabloom.llm.exact import deduplicated

    return deduplicated(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of linked near copies."""
    from tabloom.llm.chosenpath import one_of_each

    return one_of_each(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    from tabloom.llm.decontam import clean_documents

    return clean_documents(docs, docs_of(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of each document, and the text they decode to, as digests."""
    from tabloom.llm.bytebpe import digests

    return digests(docs)


STAGES = [
    ("language", language),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("benchmark_leaks", benchmark_leaks),
    ("tokens", tokens),
]

#: Language identification, near copies and byte-pair merges cannot be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = docs_of(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
