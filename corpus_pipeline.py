"""From raw documents to packed training sequences: classifier, near duplicates, shared passages, mix, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm import jaccard, mixing, packing, quality, substring
from cohortloom.runtime import materialize


def _measured(docs: DataFrame) -> DataFrame:
    """The columns of documents, ``n_chars`` that of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier takes for good; toxic and poor ones go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.select(docs, quality.fit(docs, quality.grades_of(labels), 3))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard.one_of_each(docs, is_stored=True)


def shared_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that start in two places or more."""
    return _measured(substring.deduplicated(docs, is_stored=True))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time the mix takes a document; the last of a source may be cut."""
    return _measured(mixing.mix(docs, is_stored=True))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' pieces in the training sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", classify),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", shared_passages),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: The classifier, the tokenizer and the walk over links have no SQL form; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
