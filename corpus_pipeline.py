"""A corpus pipeline of five stages, each over all that its predecessor kept.

Language ID, near-duplicate removal, removal of repeated passages, benchmark
decontamination, and mixing sources to target weights.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, jaccard, langid, mixing, parsing
from tessera.llm.shared import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _same(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those without any letter go, and lang becomes the predicted one.

    Rows that share a doc_id are judged by their own texts.
    """
    return langid.keep_identified(_same(docs)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the smallest doc_id of its component."""
    return jaccard.keep_one(_same(docs)).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated strings of 256 bytes where they cover 50 words or more (whole characters only); texts that this empties go."""
    return parsing.cut_repeats(_same(docs), width=256, least_words=50).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item stands."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.clean_documents(_same(docs), benchmark).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of the documents that the mix takes at least once."""
    return mixing.mix_sources(_same(docs)).filter("taken > 0")


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixture),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; a table in the shared folder ends each but the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL expresses neither the classifiers nor the banded alignment; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None
