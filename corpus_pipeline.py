"""Documents from raw to tokens: quality rules, near-duplicate join, secret redaction, mixing, byte-level BPE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablemill.llm import bpe, mixing, ngram_join, quality_rules, secret_scan
from tablemill.llm.common import documents
from tablemill.llm.queries import PATTERN, RANK_FILE
from tablemill.scratch import stored_alone


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the default policy rejects go."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that share four fifths of their five-word n-grams, one stays."""
    return ngram_join.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text are replaced by a mark."""
    return secret_scan.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by their targets; a document that is taken twice is there twice."""
    return mixing.mixed_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and digests; a document that the mix takes twice has two rows."""
    return bpe.encode(docs, RANK_FILE, PATTERN)


STAGES = [("quality_rules", quality), ("ngram_join", near_duplicates), ("secret_scan", secrets), ("mixing", mix), ("bpe", tokens)]
#: SQL cannot express near duplicates by signatures or byte-pair merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage is written and read again, so that none is computed twice and lineage stays short. What a stage stores
    on its way goes when it is written."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = stored_alone(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
