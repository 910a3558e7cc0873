"""Stable equitable error in probability space for precipitation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.columns import CELL
from gridspark.functions.quantiles import with_quantiles
from gridspark.session import stored


def seeps_weights(p1: Column, p3: Column) -> Column:
    """Nine weights of the 3x3 category table, row by row (forecast category first).

    Fixed values of the score: which inverse probability stands in which slot.
    """
    def inverse(p):
        return F.try_divide(F.lit(1.0), p)

    dry, light, heavy, not_heavy = inverse(1 - p1), inverse(p1), inverse(p3), inverse(1 - p3)
    zero = F.when(not_heavy.isNotNull(), 0.0)
    return F.array(zero, dry, heavy + dry,
                   light, zero, heavy,
                   light + not_heavy, not_heavy, zero)


def seeps_matrix(params: DataFrame, on: Sequence[str] = CELL) -> DataFrame:
    """Weights as rows ``(cell, idx, w)``."""
    return params.select(*on, F.posexplode(seeps_weights(F.col("p1"), F.col("p3"))).alias("idx", "w"))


def seeps_climatology(df: DataFrame, value: str = "ref_", light: float = 5.0, on: Sequence[str] = CELL) -> DataFrame:
    """Share of dry values p1, share of strong ones p3, and both thresholds, per cell.

    The strong threshold is the 2/3 quantile of the wet values of the cell.
    """
    rows = with_quantiles(df.where(F.col(value).isNotNull()), on, value, {"_t3": 2 / 3}, F.col(value) > light)
    return rows.groupBy(*on).agg(
        F.avg((F.col(value) <= light).cast("double")).alias("p1"),
        F.avg((F.col(value) >= F.col("_t3")).cast("double")).alias("p3"),
        F.lit(light).alias("t1"), F.max("_t3").alias("t3"))


def seeps(df: DataFrame, params: DataFrame, by: Sequence[str] = (), on: Sequence[str] = CELL, fcst: str = "fcst",
          ref: str = "ref_") -> DataFrame:
    """Mean of 1 - weight, where the weight follows from both categories; missing values are left out.

    ``params`` gives p1, p3, t1, t3 per cell, one row each.
    """
    def category(v):
        return (v > F.col("t1")).cast("int") + (v >= F.col("t3")).cast("int")

    weighted = params.select(*on, "t1", "t3", seeps_weights(F.col("p1"), F.col("p3")).alias("_w"))
    joined = df.join(stored(weighted, "seeps-weights"), list(on))
    idx = 3 * category(F.col(fcst)) + category(F.col(ref))
    return joined.groupBy(*by).agg(F.avg(1 - F.get("_w", idx)).alias("seeps"))
