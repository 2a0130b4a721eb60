"""The registered queries: each operator over its whole driver table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from larder.llm import chat, decontamination, fingerprints, hamming, language, licenses, lm, minhash, phrases, quality, sentencepiece_codec, tries, warc
from larder.llm.common import table
from larder.llm.oracles import ORACLES

Query = Callable[[SparkSession, str], DataFrame]


def _op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination_digest(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encoded_documents(spark, table(spark, sf_dir, "documents"))


def _op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicate_classes(spark, table(spark, sf_dir, "documents"))


def _op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_digest(spark, table(spark, sf_dir, "pages"))


def _op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_predictions(spark, table(spark, sf_dir, "documents"))


def _op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming.top_k(spark, table(spark, sf_dir, "embeddings"))


def _op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(spark, table(spark, sf_dir, "documents"))


def _op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(spark, table(spark, sf_dir, "conversations"))


def _op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licence_scan(spark, table(spark, sf_dir, "documents"))


def _op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.neighbour_digests(spark, table(spark, sf_dir, "documents"))


def _op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.rebuilt_trie(spark, table(spark, sf_dir, "conversations"))


def _op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(spark, table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_quality_classifier": _op1,
    "op2_benchmark_decontamination": _op2,
    "op3_sentencepiece_codec": _op3,
    "op4_minhash_near_duplicates": _op4,
    "op5_warc_archives": _op5,
    "op6_language_id": _op6,
    "op7_hamming_top_k": _op7,
    "op8_lm_scoring": _op8,
    "op9_chat_formatting": _op9,
    "op10_licence_scan": _op10,
    "op11_document_fingerprints": _op11,
    "op12_conversation_trie": _op12,
    "op13_phrase_collocations": _op13,
}


def queries() -> dict[str, Query]:
    from corpus_pipeline import run

    return QUERIES | {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
