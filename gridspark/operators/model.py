"""Scoring of models over grid tables, and permutation importance."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.columns import CELL, require
from gridspark.operators.resample import move_patches, patch_permutation, time_permutation
from gridspark.operators.scores import score as score_by_name


def fit_linear(df: DataFrame, predictors: Sequence[str], target: str) -> dict[str, float]:
    """Least squares of a target on predictors over all cells: coefficients by name, and ``intercept``."""
    require(df, [*predictors, target])
    rows = VectorAssembler(inputCols=list(predictors), outputCol="_x", handleInvalid="skip").transform(
        df.select(*predictors, F.col(target).alias("_y")).where(F.col("_y").isNotNull()))
    fit = LinearRegression(featuresCol="_x", labelCol="_y", solver="normal", standardization=False).fit(rows)
    return {**dict(zip(predictors, fit.coefficients.tolist())), "intercept": fit.intercept}


def linear_prediction(coefficients: dict[str, float]) -> Column:
    """The fitted model as a column expression."""
    total = F.lit(coefficients["intercept"])
    for name, c in coefficients.items():
        if name != "intercept":
            total = total + c * F.col(name)
    return total


def batch_inference(df: DataFrame, model: Callable[[pd.DataFrame], pd.Series], inputs: Sequence[str],
                    keys: Sequence[str] = ("time", *CELL), mu: float = 0.0, sigma: float = 1.0,
                    out: str = "fcst") -> DataFrame:
    """Predictions of any model that takes a table of inputs, batch by batch, back in physical units."""
    require(df, [*keys, *inputs])
    fields = ", ".join(f"{n} {t}" for n, t in df.select(*keys).dtypes) + f", {out} double"

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[list(keys)].assign(**{out: model(batch[list(inputs)]) * sigma + mu})

    return df.select(*keys, *inputs).mapInPandas(predict, fields)


def field_inference(df: DataFrame, model: Callable[[np.ndarray], np.ndarray], nx: int, ny: int, keys: Sequence[str] = ("time",),
                    tensor: str = "tensor", mu: float = 0.0, sigma: float = 1.0, out: str = "fcst") -> DataFrame:
    """Predictions of a model over whole fields, back in physical units: one row per key and cell.

    ``df`` has a tensor per key as ``field_tensor`` makes it; the model takes a batch of shape (fields, ny, nx, channels) and
    returns one of (fields, ny, nx).  A field with missing cells has no prediction.
    """
    require(df, [*keys, tensor])
    fields = df.select(*keys).schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column(tensor)
            values = cells.flatten().flatten().to_numpy(zero_copy_only=False)
            result = model(values.reshape(len(cells), ny, nx, -1)) if len(cells) else np.zeros((0, ny, nx))
            values = (np.asarray(result, dtype=np.float64) * sigma + mu).reshape(len(cells) * ny * nx)
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(cells) + 1, dtype=np.int32) * (ny * nx)), pa.array(values))
            yield pa.RecordBatch.from_pydict({k: batch.column(k) for k in keys} | {"_field": rows})

    whole = df.select(*keys, tensor).where(F.col(tensor).isNotNull())
    found = whole.mapInArrow(predict, f"{fields}, _field array<double>").select(*keys, F.posexplode("_field").alias("_pos", out))
    return found.select(*keys, F.floor(F.col("_pos") / nx).cast("int").alias("iy"), (F.col("_pos") % nx).cast("int").alias("ix"), out)


def permuted_inputs(df: DataFrame, predictors: Sequence[str], nx: int, ny: int, patch: tuple[int, int],
                    seed: int | str = 42, time: str = "time") -> DataFrame:
    """The table once per predictor with this predictor alone permuted in time and space.

    Only the narrow permuted values are moved; they meet the untouched table in one join.
    """
    names = F.array(*[F.lit(p) for p in predictors])
    times = df.select(time).distinct().withColumn("predictor", F.explode(names))
    time_moves = time_permutation(times, seed, time, ["predictor"])
    patch_moves = patch_permutation(df.sparkSession, nx, ny, patch, seed, predictors)
    long = df.unpivot([time, *CELL], list(predictors), "predictor", "_value")
    moved = long.join(time_moves, ["predictor", time]).withColumn(time, F.col("time_to")).drop("time_to")
    moved = move_patches(moved, patch_moves, patch, ["predictor"])
    joined = moved.join(df, [time, *CELL])
    return joined.withColumns({p: F.when(F.col("predictor") == p, F.col("_value")).otherwise(F.col(p))
                               for p in predictors}).drop("_value")


def feature_importance(df: DataFrame, predictors: Sequence[str], target: str, nx: int, ny: int,
                       predict: Column | Callable[[DataFrame], DataFrame], score: str = "rmse",
                       patch: tuple[int, int] = (6, 6), seed: int | str = 42, time: str = "time", **options) -> DataFrame:
    """Score per predictor and time when that predictor is permuted: ``(predictor, time, score)``.

    ``predict`` is a column expression, or a function that adds a ``fcst`` column to the permuted table.
    All predictors run in the same job.  The score is any of the registry, with its ``options``.
    """
    require(df, [*predictors, target])
    permuted = permuted_inputs(df, predictors, nx, ny, patch, seed, time)
    scored = permuted.withColumn("fcst", predict) if isinstance(predict, Column) else predict(permuted)
    found = score_by_name(scored, score, ["predictor", time], fcst="fcst", ref=target, **options)
    return found.select("predictor", time, F.col(score).alias("score"))


def importance_relative(importance: DataFrame, ref_score: Column) -> DataFrame:
    """Importance as a multiple of the score without permutation."""
    return importance.withColumn("rel_change", F.try_divide(F.col("score"), ref_score))


def importance_axis_max(relative: DataFrame) -> DataFrame:
    """Upper end of the axis that shows the relative changes."""
    return relative.agg(F.ceil(F.max("rel_change") + 1).alias("axis_max"))
