"""A corpus pipeline: language ID, quality rules, near-duplicates, mixture, tokens. Every stage reads what its predecessor wrote."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import bpe, langid, mixing, neardup, quality
from palimpsest.llm.common import Scratch, read_table
from palimpsest.llm.queries import RANKS, WEIGHTS, levels


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that does not plainly contradict their ``lang``."""
    return langid.accept(docs, langid.train(docs))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the fixed limits and are no outliers of their language and source."""
    return quality.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every group of near-duplicates: five-word shingles, similarity 0.8 or more."""
    return neardup.deduplicated(docs, width=5, threshold="0.8")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nine tenths of the tokens, by language weights, each document at most once."""
    return mixing.mixed_documents(docs, levels(), WEIGHTS, total_share="0.9", max_epochs=1, seed=1)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and digests of ids and of the decoded text."""
    return bpe.encode_documents(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("language ID", language),
    ("quality rules", rules),
    ("near-dedup", near_duplicates),
    ("mixing", mixture),
    ("byte-level BPE", tokens),
]

#: No SQL: a trained network and BPE are among the stages. tests/llm checks the stages one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage wrote goes when the next has written its own."""
    scratch = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    written = None
    for _, stage in STAGES:
        docs = scratch.cut(stage(spark, docs, sf_dir))
        if written is not None:
            scratch.drop(written)
        written = docs
    return docs
