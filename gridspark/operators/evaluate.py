"""Breakdowns of scores by time of day, season and map cell, and the numbers behind box plots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.columns import CELL
from gridspark.functions.calendar import season_of
from gridspark.functions.quantiles import with_quantiles
from gridspark.session import stored


def mean_std(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(value).alias(f"{value}_mean"), F.stddev_pop(value).alias(f"{value}_std"))


def with_time_parts(df: DataFrame, time: str = "time") -> DataFrame:
    return df.withColumns({"hour": F.hour(time), "season": season_of(F.col(time))})


def score_by_hour(scores: DataFrame, value: str, time: str = "time") -> DataFrame:
    """Mean and spread of a per-time score by hour of the day."""
    return mean_std(with_time_parts(scores, time), value, ["hour"])


def score_breakdown(scores: DataFrame, value: str, time: str = "time") -> DataFrame:
    """By season and hour, by hour of the whole year, by season, and overall, in one pass; a total is NULL in
    the columns it sums over."""
    parts = with_time_parts(scores, time)
    season, hour = F.col("season"), F.col("hour")
    return (parts.groupingSets([[season, hour], [hour], [season], []], season, hour)
            .agg(F.avg(value).alias(f"{value}_mean"), F.stddev_pop(value).alias(f"{value}_std")))


def scores_table(per_hour: DataFrame, value: str) -> DataFrame:
    """The table that is saved per score: hour, mean and spread."""
    return per_hour.select("hour", f"{value}_mean", f"{value}_std")


def score_map(df: DataFrame, by: Sequence[str] = (), on: Sequence[str] = CELL, fcst: str = "fcst",
              ref: str = "ref_", time: str = "time") -> DataFrame:
    """Maps over time: mean absolute error and root mean square error per cell, optionally per hour or season."""
    d = F.col(fcst) - F.col(ref)
    parts = with_time_parts(df, time) if by else df
    return parts.groupBy(*by, *on).agg(
        F.avg(d).alias("bias"), F.avg(F.abs(d)).alias("abs_error_mean"), F.sqrt(F.avg(d * d)).alias("rmse"))


def boxplot_stats(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Quartiles, whiskers (the furthest values within 1.5 quartile ranges) and the largest outlier."""
    joined = with_quantiles(df.where(F.col(value).isNotNull()), by, value, {"_q1": 0.25, "_median": 0.5, "_q3": 0.75})
    reach = 1.5 * (F.col("_q3") - F.col("_q1"))
    v, lo, hi = F.col(value), F.col("_q1") - reach, F.col("_q3") + reach
    return joined.groupBy(*by).agg(
        F.max("_q1").alias("q1"), F.max("_median").alias("median"), F.max("_q3").alias("q3"),
        F.least(F.min(F.when(v >= lo, v)), F.max("_q1")).alias("whisker_lo"),
        F.greatest(F.max(F.when(v <= hi, v)), F.max("_q3")).alias("whisker_hi"),
        F.max(F.when((v < lo) | (v > hi), v)).alias("outlier_max"))


def baseline_difference(df: DataFrame, coarse: str, downscaled: str, target: str,
                        on: Sequence[str] = CELL) -> DataFrame:
    """Error of the coarse input next to the error of the downscaled field, per cell."""
    return df.groupBy(*on).agg(F.avg(F.col(coarse) - F.col(target)).alias("input_error"),
                               F.avg(F.col(downscaled) - F.col(target)).alias("downscaled_error"))


def dataset_info(df: DataFrame, group: str, time: str = "time") -> DataFrame:
    """Samples, cells and the largest number of samples in one group of files, as one row."""
    steps = df.select(group, time).distinct().groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    cells = df.select(*CELL).distinct().agg(F.count(F.lit(1)).alias("cells"))
    return steps.agg(F.sum("n").alias("samples"), F.max("n").alias("max_samples"),
                     F.count(F.lit(1)).alias("groups")).withColumn("cells", cells.scalar())


def level_bins(value, first: float, last: float, n: int):
    """Number of the equally wide level bin of a value: 0 below the first level, n + 1 from the last on."""
    return F.width_bucket(value, F.lit(float(first)), F.lit(float(last)), F.lit(n))


def worst_times(scores: DataFrame, value: str, k: int, time: str = "time") -> DataFrame:
    return scores.orderBy(F.desc_nulls_last(value), F.col(time)).limit(k)
