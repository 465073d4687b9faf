"""A training corpus from raw documents: quality, exact and near duplicates, mixing of sources, tokens.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept.  All but the last return the columns
of `documents`; rows they reject are gone.  Null or empty texts pass the quality stage only if their score does, are equal
to each other in the second, link with nothing in the third, and have no tokens in the last; an empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from millrace.llm.bpe import bpe_tokens
from millrace.llm.exact import drop_exact
from millrace.llm.jaccard import keep_one
from millrace.llm.mixing import mix_sources
from millrace.llm.pu import fit_scorer, passing
from millrace.llm.store import stored

QUALITY_THRESHOLD = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier, fitted on the labelled ones among them, rejects."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return passing(docs, fit_scorer(docs, labels, "quality", "shape"), QUALITY_THRESHOLD)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves one of equal texts."""
    return drop_exact(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves the smallest id of each group of near duplicates."""
    return keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources have their target weights, in a global random order."""
    return mix_sources(docs, extras=False)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, one row per copy in the mix."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe_tokens(docs, path, public_tokenizers.PATTERN).drop("decoded")


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mix_sources", mix), ("byte_bpe", tokens)]

#: The quality stage is a trained model, which SQL can't express; tests check the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
