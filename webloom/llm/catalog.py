"""The registered queries of this subpackage and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from webloom.llm import oracle
from webloom.llm.common import read, tokenizer_path
from webloom.llm.convtrie import prefix_trie
from webloom.llm.decontam import benchmark_leaks
from webloom.llm.jaccard import jaccard_components
from webloom.llm.langid import identify
from webloom.llm.licenses import license_paragraphs
from webloom.llm.packing import pack
from webloom.llm.pivots import near_duplicates
from webloom.llm.quality import quality_scores
from webloom.llm.resampling import resample
from webloom.llm.secrets import secret_scan
from webloom.llm.tokens import token_counts
from webloom.llm.toxicity import toxicity_scores
from webloom.llm.urlglob import filter_urls

TOKENIZER = "word_bpe_49k.json"


def op1_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(read(spark, sf_dir, "documents", "doc_id", "text", "source", "lang"))


def op2_license_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_paragraphs(read(spark, sf_dir, "documents", "doc_id", "text"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents", "doc_id", "text"), k=3, num=90, den=100)


def op4_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path(TOKENIZER), length=2048, end_id=1)


def op5_language_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read(spark, sf_dir, "documents", "doc_id", "text", "lang"), folds=4, held_fold=2)


def op6_toxicity_subwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "labels"),
                           folds=5, threshold=0.5)


def op7_benchmark_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_leaks(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark"))


def op8_pivot_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"), least=0.93)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path(TOKENIZER), limit=2048)


def op10_quality_fourier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "labels"),
                          folds=5, threshold=0.3)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark", "text"),
                    percent=25, least_words=20, seed="7")


def op12_url_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read(spark, sf_dir, "pages", "page_id", "url"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_secret_ownership, op2_license_paragraphs, op3_jaccard_join, op4_hilbert_packing, op5_language_profiles,
        op6_toxicity_subwords, op7_benchmark_simhash, op8_pivot_permutation, op9_token_counts, op10_quality_fourier,
        op11_importance_resampling, op12_url_automaton, op13_conversation_trie)}


def oracle_sql() -> dict[str, str]:
    return {"op11_importance_resampling": oracle.RESAMPLING, "op12_url_automaton": oracle.URLS,
            "op13_conversation_trie": oracle.TRIE}
