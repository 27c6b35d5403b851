"""A training-data pipeline over the documents table: each stage works on all documents the one before has kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agentlog.llm import exact, langid, minhash, mixture, pieces
from agentlog.llm.common import small_batches, table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be determined go; those without one get the predicted one."""
    model = langid.fit(docs.where(~langid.is_held_out(F.col("doc_id"))))
    with small_batches(spark):
        return written(langid.with_known_language(docs, model, lang="lang"), "known")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest doc_id stays."""
    return exact.drop_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a likeness of 0.8 or more, the smallest doc_id stays."""
    return minhash.drop_near_duplicates(docs, words=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with the words the mix takes from it, repeats included; documents without any go."""
    mixed = mixture.mixed_documents(docs)
    return mixed.withColumn("n_chars", F.char_length("text").cast(dict(docs.dtypes)["n_chars"])).select(*docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and digests of each text."""
    encoded = pieces.encode(docs.select("doc_id", "source", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    with small_batches(spark):
        return written(encoded.select("doc_id", "source", "ids", *pieces.digests(encoded)), "encoded")


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("sentencepiece", sentencepiece),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs


# SQL has no SentencePiece, language classifier or pseudorandom mix; tests compare with brute force.
ORACLE_SQL = None
