"""A corpus for training from raw documents, stage by stage.

Each stage takes what the stage before it kept, as a written table, and returns
the columns of ``documents``; the last returns token ids.  ``run`` applies all
of them.  A stage is one operator of ``larder.llm`` with its production
parameters, over all of its input.

Null and empty texts: the quality stage judges them by its bias, the language
stage rejects them (no letter, so no language).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import decontamination, language, minhash, quality, sentencepiece_codec
from larder.llm.common import columns, stored, table

#: A language prediction below this posterior counts as no language.
MIN_LANGUAGE_SCORE = 0.5


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted as label 1 of ``labels.quality``."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored, _, predicted = quality.score(spark, docs, model)
    return scored.where(F.col(predicted) == 1).select(columns(docs))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a posterior of at least one half."""
    told, pred, score = language.identify(spark, docs, language.fit(docs))
    return told.where((F.col(pred) != "und") & (F.col(score) >= MIN_LANGUAGE_SCORE)).select(columns(docs))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: that with the smallest id."""
    return minhash.keep_first(spark, docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by ``benchmark``."""
    judged, at = decontamination.decontaminate(spark, docs, table(spark, sf_dir, "benchmark"))
    return judged.where(~F.col(at["contaminated"])).select(columns(docs))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with the checks of the codec."""
    coded, at = sentencepiece_codec.encode(spark, docs.select("doc_id", "lang", "source", "text"))
    return coded.select("doc_id", "lang", "source", *[F.col(at[k]).alias(k) for k in ("ids", "n_tokens", "round_trip", "parity")])


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", good_quality),
    ("language_id", known_language),
    ("near_duplicates", without_near_copies),
    ("benchmark_decontamination", without_benchmark),
    ("sentencepiece_ids", token_ids),
]

#: The learned stages cannot be put into SQL; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(spark, stage(spark, docs, sf_dir), name)
    return docs
