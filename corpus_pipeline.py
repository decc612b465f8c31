"""A corpus in five stages: classified, ruled, deduplicated, mixed and encoded.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and is written before the
next one reads it. All but the last return the columns of documents, with any that documents have besides; the last one row for each row of the mix.

Null and empty texts are scored like others, fail the rules' 50 words and so go in the second stage. Rows without an id, or
that share one, are rows of their own until the third stage, which keeps one row of each group of near duplicates and of each
id. Without labels of either kind the first stage keeps everything. An empty table gives empty stages. Ids are integers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import bpe, cotraining, jaccard, mixing, repetition
from plumbline.llm.common import prepare, table, written
from plumbline.llm.entries import tokenizer_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier takes for low quality go."""
    prepare(spark)
    return cotraining.keep(docs, cotraining.fit(docs, table(spark, sf_dir, "labels")))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the repetition limits reject go."""
    prepare(spark)
    return repetition.keep(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    prepare(spark)
    return jaccard.representatives(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources meet their targets."""
    prepare(spark)
    return mixing.mixed_documents(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and hashes of ids and decoded text of every row of the mix."""
    prepare(spark)
    return bpe.encode(docs, tokenizer_path())


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("mixing_sources", mixing_sources),
    ("bpe_encoding", bpe_encoding),
]

#: SQL has neither the classifier, nor the permuted draws, nor the tokenizer: tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
