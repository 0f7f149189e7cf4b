"""Corpus pipeline: quality, near duplicates, benchmark leaks, secrets, packing; every stage is a Spark job of its own.

Each stage takes (spark, docs, sf_dir) and its result is written as Parquet into the shared folder and read again, so
a lost executor repeats one stage at most. All but the last return the columns of ``documents``, extra columns included.

Rows with null doc_id are kept by every filter that needs an id; null texts are empty; repeated rows are one document
and stay or go together; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from costweave.llm import decontaminate, ngram_jaccard, packing, quality, secrets
from costweave.session import stage, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior of good quality reaches the cut."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a 5-word-shingle Jaccard similarity of 0.8 or more, the one with the smallest doc_id."""
    return ngram_jaccard.deduplicate(docs)


def no_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window that is similar to a benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced."""
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their places in training sequences."""
    return packing.pack(packing.pieces(docs))


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", one_of_each),
    ("benchmark decontamination", no_leaks),
    ("secret scans", redacted),
    ("best-fit packing", packed),
]

#: SQL has neither the fitted classifier nor the tokenizer; tests/llm compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
