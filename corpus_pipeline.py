"""Corpus pipeline: quality rules, near duplicates, repeated passages, test items, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents.  Between stages the documents are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm._tables import read, spool
from quarry.llm.decontamination import decontaminate
from quarry.llm.ngram_jaccard import one_of_each
from quarry.llm.packing import best_fit_packing, document_items
from quarry.llm.quality_rules import good_documents
from quarry.llm.substring_dedup import substring_dedup

ORACLE_SQL = None  # hashed n-gram ratios, recompression and best fit have no SQL: see tests/llm


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return good_documents(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words to a shingle, similarity 0.8."""
    return one_of_each(docs, size=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without what an earlier one has; those of which nothing is left go, and n_chars follows the text."""
    left = substring_dedup(docs)
    left = left.filter("n_removed = 0 or n_removed < n_words").drop("n_words", "n_removed")
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate(docs, read(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of the documents' pieces."""
    return best_fit_packing(document_items(docs))


STAGES = [("quality_rules", quality), ("ngram_jaccard_join", near_duplicates), ("substring_dedup", repeated_passages), ("benchmark_decontamination", test_items), ("best_fit_packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = spool(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
