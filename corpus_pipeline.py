"""The corpus pipeline: five stages over the documents table, each an operator of shelfline.llm.

Each stage works on all rows its predecessor kept and takes effect: documents that the quality classifier rejects go;
of equal texts the largest doc_id stays; of near duplicates the smallest doc_id stays; the mix repeats or leaves out
documents so that sources come near their targets; and what is left is encoded and decoded. Stages but the last return
the columns they were given. Null texts count as empty everywhere, and empty tables pass through."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from shelfline.llm import bloom_dedup, mixing, near_copies, piece_codec, quality
from shelfline.llm.common import stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more by the classifier, fitted to labelled rows outside of the held-out fold."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.accepted(docs, model, 0.7)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return bloom_dedup.distinct_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more of their five-word shingles one stays: SimHash proposes pairs,
    and min-hash bands those that are beyond its radius."""
    return near_copies.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them on average, so that each source comes near its target."""
    return mixing.mixed_documents(docs, on_average=True)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of what is left."""
    return piece_codec.round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", keep_quality),
    ("exact dedup", exact_dedup),
    ("simhash near-dedup", near_dedup),
    ("mixing sources", mix_sources),
    ("sentencepiece", sentencepiece),
]

#: Classifier, draws and encoding are beyond SQL; the tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each over the stored result of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
