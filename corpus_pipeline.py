"""The corpus pipeline: quality rules, near copies, repeated strings, test items, packing.

Each stage works on all that the one before kept; its result is written to the shared folder and
read again, so a lost executor costs at most the stage that runs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from newswatch.llm import decontaminate, ngram_join, packing, quality_rules, suffix_dedup
from newswatch.llm.common import table, written
from newswatch.llm.queries import END, WORD_TOKENIZER


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the risk-controlled cutoffs keep."""
    return quality_rules.good_documents(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group linked by shingles."""
    return ngram_join.one_of_each(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that repeated 400-byte strings cover."""
    return suffix_dedup.without_repeats(docs)


def clean_of_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all that is left."""
    return packing.digests(packing.pack(docs, public_tokenizers.path(WORD_TOKENIZER), END))


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_copies),
    ("suffix-array dedup", repeated_strings),
    ("benchmark decontamination", clean_of_test_items),
    ("packing", packed),
]

# SQL cannot express the joins and the transforms; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
