"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.llm import (alignment, centroids, chat, gif, language, licenses, maxent, mixing, neardup, pages, pieces, quality,
                           toxicity)
from gridspark.llm.words import documents, fold

Build = Callable[[SparkSession, str], DataFrame]


def piece_model_path() -> str:
    """The installed public model of the merge type; ``pieces`` takes any path."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def byte_vocabulary_path() -> str:
    """The installed public byte-level vocabulary; ``alignment`` takes any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = piece_model_path()
    encoded = pieces.encode(documents(spark, sf_dir), path, carry=["doc_id"])
    decoded = pieces.decode(encoded, path)
    return decoded.select("doc_id", (F.length("piece_ids") / 4).cast("bigint").alias("n_tokens"),
                          F.sha2("piece_ids", 256).alias("ids_sha256"),
                          F.sha2(F.col("piece_text").cast("binary"), 256).alias("decoded_sha256"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir))


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op5_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.digests(gif.store(documents(spark, sf_dir), carry=["doc_id"])).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    rows, share = toxicity.labelled(docs, labels.where(fold(F.col("doc_id"), 4) != 2))
    model = toxicity.fit(rows, share=share)
    return toxicity.score(docs.select("doc_id", "text", held_out.alias("held_out")), model, carry=["doc_id", "held_out"])


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(documents(spark, sf_dir))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                         "failed_rules")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language.fit(language.training_rows(docs))
    judged = language.score(docs, model, carry=["doc_id"])
    held_out = F.coalesce(fold(F.col("doc_id"), language.FOLDS) == 0, F.lit(False))
    return judged.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op9_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = fold(F.col("doc_id"), 7)
    return maxent.score(documents(spark, sf_dir), part != 2, part == 2)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(documents(spark, sf_dir))


def op11_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    formatted = chat.format_conversations(chat.text_parts(rows.unionByName(chat.injected(spark, rows.schema))))
    return chat.digests(formatted).select(
        "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.align(documents(spark, sf_dir), byte_vocabulary_path(), piece_model_path(), carry=["doc_id"])
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), carry=["vec_id"])
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(
        F.array_join("centroid", ",").cast("binary"), 256).alias("centroid_sha256"))


QUERIES: dict[str, Build] = {q.__name__: q for q in (
    op1_pieces, op2_near_duplicates, op3_main_text, op4_licenses, op5_gif, op6_toxicity, op7_quality_rules, op8_language, op9_maxent,
    op10_mixing, op11_chat, op12_alignment, op13_centroids)}

SQL: dict[str, str] = {"op2_near_duplicates": neardup.ORACLE_SQL, "op4_licenses": licenses.oracle_sql(),
                       "op7_quality_rules": quality.oracle_sql(), "op11_chat": chat.oracle_sql(), "op13_centroids": centroids.oracle_sql()}
