"""Corpus pipeline: quality rules, near-duplicate join, substring removal, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on all documents its predecessor kept;
``run`` stores every stage's result as Parquet in the shared folder and reads it again,
so a lost executor costs one stage at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from siftline.llm import bpe, mixing, ngram_join, quality, suffix_dedup
from siftline.session import cut_lineage

#: Bytes of a repeated string.  At sf0.1 the shortest passage of 51 words that two documents
#: within the base quality rule share has 245, the shortest of 50 in ``benchmark`` 260.
PASSAGE_BYTES = 240
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines above the limits."""
    return quality.apply_quality_rules(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8."""
    return ngram_join.keep_one(docs, width=5, percent=80)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings that repeat across the corpus."""
    return suffix_dedup.apply_dedup(docs, window=PASSAGE_BYTES)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources by weight; documents may stand in it once or twice."""
    return mixing.apply_mix(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, with digests of ids and decoded bytes."""
    return bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("quality_rules", quality_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("suffix_dedup", substring_stage),
    ("mix_sources", mixing_stage),
    ("byte_bpe", encoding_stage),
]

#: SQL can express neither the links of near duplicates at scale nor the encoding;
#: tests compare ``run`` with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; returns the last stage's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return docs
