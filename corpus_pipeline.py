"""The text pipeline: from raw documents to token ids on file.

Quality rules drop texts, one document of each group of near-duplicates stays, documents with
passages of the benchmark go, sources are mixed to their weights, and what is left is written
as token ids. Each stage takes what the one before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from runledger.llm import binary, decontaminate, mixing, neardup, quality
from runledger.llm.common import documents, stored
from runledger.llm.queries import vocabulary


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose votes speak for them."""
    return quality.keep_good(docs)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 80 % of its shingles of five words."""
    return neardup.keep_one(docs, neardup.SHINGLE_WORDS, neardup.PERCENT)


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without ten words in a row from a benchmark item."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids on file; place, number and checksum of each document's ids as read back."""
    return binary.tokens_on_file(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality rules", good_documents),
    ("MinHash near-dedup", distinct_documents),
    ("benchmark decontamination", clean_documents),
    ("mixing sources", mixed_documents),
    ("token-ID output", token_files),
]

# SQL has no tokenizer; tests/llm compares the rows with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's rows are a table before the next begins."""
    docs = documents(spark, sf_dir)
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = stored(docs, f"pipeline-{number}")
    return docs
