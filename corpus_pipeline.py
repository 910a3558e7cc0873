"""From documents to tokens: quality rules, language, near-duplicates, source mix, pieces."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.llm import language, mixing, neardup, pieces, quality
from gridspark.llm.catalog import piece_model_path
from gridspark.session import scratch_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality.keep_good(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language of the training folds of their table.

    A table without labels has no languages: then all documents stay, and a warning says so.
    """
    model = language.fit(language.training_rows(docs))
    if not model.languages:
        warnings.warn("no document has a language label: none is rejected by its language", stacklevel=2)
        return docs
    return language.keep_identified(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return neardup.one_of_each(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes: one row per document and pass over its source."""
    return mixing.mixed_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the pieces of each text, and whether decoding them gives the text back."""
    decoded = pieces.encode_decode(docs, piece_model_path(), carry=["doc_id", "lang", "source", "text"])
    return decoded.select("doc_id", "lang", "source", (F.length("piece_ids") / 4).cast("bigint").alias("n_tokens"), "piece_ids",
                          (F.coalesce("text", F.lit("")) == F.col("piece_text")).alias("round_trip"))


STAGES = [("quality_rules", quality_rules), ("language_id", language_id), ("near_duplicates", near_duplicates),
          ("source_mix", source_mix), ("encoding", encoding)]

#: Signatures, models and permutations have no form in SQL; the tests hold each stage against a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
