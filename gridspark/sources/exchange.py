"""Score tables as CSV and normalisation statistics as JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATS_SCHEMA = "variable string, mu double, sigma double, data_type string"
Z_SCORE = "z_score"


def write_scores(scores: DataFrame, path: str) -> None:
    scores.write.option("header", True).csv(path)


def read_scores(spark: SparkSession, paths: Sequence[str], value: str) -> DataFrame:
    """Score tables of several experiments, each labelled with the id in its folder name."""
    schema = f"hour int, {value}_mean double, {value}_std double"
    rows = spark.read.option("header", True).schema(schema).csv(list(paths))
    folder = F.regexp_extract(F.col("_metadata.file_path"), "id([^_/]*)_[^/]*/[^/]*$", 1)
    return rows.withColumn("exp", folder)


def write_stats(stats: DataFrame, path: str, norm: str = Z_SCORE) -> None:
    """Save statistics with the name of their method; missing ones are refused."""
    unset = stats.agg(F.count(F.lit(1)).alias("n"),
                      F.count_if(F.col("mu").isNull() | F.col("sigma").isNull()).alias("nulls")).first()
    if unset["n"] == 0 or unset["nulls"] > 0:
        raise ValueError("statistics are not set, nothing to save")
    stats.withColumn("data_type", F.lit(norm)).write.json(path)


def read_stats(spark: SparkSession, path: str, norm: str = Z_SCORE, keys: str = "") -> DataFrame:
    """Saved statistics; ``keys`` declares the columns of their keys, as in ``"iy int, ix int"``.

    Several rows per key and variable are an error, so keys that were saved must be declared.
    """
    rows = spark.read.schema(", ".join(filter(None, (keys, STATS_SCHEMA)))).json(path)
    names = [c for c in rows.columns if c not in ("variable", "mu", "sigma", "data_type")]
    if not rows.groupBy(*names, "variable").count().where("count > 1").isEmpty():
        raise ValueError("the file holds several statistics of a variable; declare its keys")
    checked = F.when(F.col("data_type") == norm, F.col("mu")).otherwise(
        F.raise_error(F.concat(F.lit(f"statistics are not of type {norm}: "), F.coalesce("data_type", F.lit("none"))))
        .cast("double"))
    return rows.select(*names, "variable", checked.alias("mu"), "sigma")
