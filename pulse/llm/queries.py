"""The registered queries of this subpackage: each applies one operator, with
its production parameters, to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, html, importance, jaccard, langid, lexical, packing, rules, spots, suffix, tokens, whitening
from .common import read


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.report(chat.with_control_case(read(spark, sf_dir, "conversations")))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(read(spark, sf_dir, "pages"))


def op4_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.report(read(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(read(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.report(read(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.report(read(spark, sf_dir, "documents"))


def op11_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.report(read(spark, sf_dir, "embeddings"))


def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spots.report(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality_rules, op2_chat_formatting, op3_html_extraction,
                            op4_importance_resampling, op5_suffix_dedup, op6_token_counts, op7_language_id,
                            op8_best_fit_packing, op9_benchmark_decontamination, op10_ngram_jaccard_join,
                            op11_ranked_lexical_search, op12_embedding_whitening, op13_document_fingerprints)}

# The others learn a model, search or pack, or are too slow in SQL on whole
# tables: their tests compare them with brute force on small ones.
ORACLE: dict[str, str] = {"op2_chat_formatting": chat.oracle(),
                          "op9_benchmark_decontamination": decontaminate.ORACLE,
                          "op10_ngram_jaccard_join": jaccard.ORACLE,
                          "op11_ranked_lexical_search": lexical.ORACLE}
