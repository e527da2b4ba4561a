"""Queries of the operators over the given tables, with SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import bpe, langid, mixing, ngram_join, nn_descent, preferences, quality, site_tree, spelling, suffix_dedup, token_counts, url_filters, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_quality_rules", quality.ORACLE_SQL)
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf, "documents")).select(*quality.OUTPUT)


@query("op4_mix_sources", mixing.ORACLE_SQL)
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf, "documents")).select(*mixing.OUTPUT)


@query("op2_byte_bpe")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf, "documents"), RANKS, public_tokenizers.PATTERN)


@query("op10_token_counts")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    """Token counts before and after three edits of every document."""
    docs = table(spark, sf, "documents")
    edited = docs.select("doc_id", "text", token_counts.sample_edits(docs["text"], docs["doc_id"]).alias("edits"))
    trees = token_counts.build_trees(edited, RANKS, public_tokenizers.PATTERN, keep=("edits",))
    return token_counts.edit_trees(trees, RANKS, public_tokenizers.PATTERN)


@query("op3_ngram_jaccard_join")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op9_nn_descent")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return nn_descent.search_table(table(spark, sf, "embeddings"))


@query("op6_language_id")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return langid.predict_languages(table(spark, sf, "documents"))


@query("op5_site_tree")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return site_tree.extract_text(table(spark, sf, "pages"))


@query("op7_suffix_dedup")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    """All documents; ``text`` is what is left of each."""
    return suffix_dedup.dedup_substrings(table(spark, sf, "documents"), with_kept=True).withColumnRenamed("kept", "text")


@query("op8_preferences", preferences.ORACLE_SQL)
def op8(spark: SparkSession, sf: str) -> DataFrame:
    """All conversations, paired with one that opens alike, else with another reply of their own.

    ``other_id`` is the twin, or the conversation that the reply is from, or the own id.
    """
    convs = preferences.conversations(table(spark, sf, "conversations"))
    made = preferences.format_preferences(preferences.pair_up(convs), convs)
    kind = F.when(F.col("rejected_id").isNotNull(), "twin").when(F.col("reply_id").isNotNull(), "reply").otherwise("alone")
    other = F.coalesce("rejected_id", "reply_id", "chosen_id")
    return made.withColumns({"kind": kind, "other_id": other}).drop("rejected_id", "reply_id")


@query("op11_url_filters", url_filters.ORACLE_SQL)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    """All urls by the host rules and the pattern rules."""
    return url_filters.judge_urls(table(spark, sf, "pages"), url_filters.rule_table(spark), keep=("page_id",))


@query("op12_spelling_variants")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    """All words of all documents with the form and root they vary."""
    return spelling.group_variants(table(spark, sf, "documents"))


@query("op13_whitening")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    """All vectors on the leading whitened components."""
    return whitening.whiten_rows(table(spark, sf, "embeddings"))
