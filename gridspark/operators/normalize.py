"""Z-score statistics and their use."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.columns import CELL, require
from gridspark.session import stored


def zscore_stats(df: DataFrame, variables: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean and population standard deviation of all variables in one pass: rows ``(by, variable, mu, sigma)``."""
    require(df, [*by, *variables])
    aggs = [F.struct(F.avg(v).alias("mu"), F.stddev_pop(v).alias("sigma")).alias(v) for v in variables]
    wide = df.groupBy(*by).agg(*aggs)
    long = wide.unpivot(list(by), list(variables), "variable", "s")
    return long.select(*by, "variable", "s.mu", "s.sigma")


def stats_columns(stats: DataFrame, variables: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Statistics rows as one row per key with ``mu_<var>`` and ``sigma_<var>``.

    A variable without statistics, or with several for one key, is an error.
    """
    aggs = []
    for v in variables:
        mine = F.col("variable") == v
        double = F.raise_error(F.lit(f"several statistics of '{v}'" + (" for one key" if by else ""))).cast("double")
        for name in ("mu", "sigma"):
            one = F.when(F.count_if(mine) > 1, double).otherwise(F.max(F.when(mine, F.col(name))))
            if not by:
                lost = F.raise_error(F.lit(f"there are no statistics of '{v}'")).cast("double")
                one = F.when(F.count_if(mine) == 0, lost).otherwise(one)
            aggs.append(one.alias(f"{name}_{v}"))
    return stats.groupBy(*by).agg(*aggs)


def normalized(value: Column, mu: Column, sigma: Column) -> Column:
    return F.try_divide(value - mu, sigma)


def denormalized(value: Column, mu: Column, sigma: Column) -> Column:
    return value * sigma + mu


def _apply(df: DataFrame, stats: DataFrame, variables: Sequence[str], by: Sequence[str], formula) -> DataFrame:
    wide = stats_columns(stats, variables, by)
    if by:
        kept = stored(wide, "statistics")
        # one row; a variable without statistics in any key is no gap but a mistake
        known = kept.agg(*[F.bool_or(F.col(f"mu_{v}").isNotNull()).alias(v) for v in variables]).first()
        lost = [v for v in variables if known[v] is not None and not known[v]]
        if lost:
            raise ValueError(f"there are no statistics of {', '.join(lost)}")
        joined = df.join(kept, list(by), "left")
        cols = {v: formula(F.col(v), F.col(f"mu_{v}"), F.col(f"sigma_{v}")) for v in variables}
        return joined.withColumns(cols).select(*df.columns)
    row = wide.select(F.struct("*").alias("s")).scalar()
    return df.withColumns({v: formula(F.col(v), row[f"mu_{v}"], row[f"sigma_{v}"]) for v in variables})


def zscore_normalize(df: DataFrame, variables: Sequence[str], stats: DataFrame | None = None,
                     by: Sequence[str] = ()) -> DataFrame:
    """``(x - mu) / sigma`` with statistics of the data or the given ones; sigma 0 gives NULL."""
    stats = zscore_stats(df, variables, by) if stats is None else stats
    return _apply(df, stats, variables, by, normalized)


def zscore_denormalize(df: DataFrame, variables: Sequence[str], stats: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return _apply(df, stats, variables, by, denormalized)


def normalize_per_cell(df: DataFrame, cell_vars: Sequence[str], global_vars: Sequence[str],
                       training: DataFrame | None = None) -> DataFrame:
    """Some variables with statistics of their grid cell over time, others with overall ones; validation data
    reuse the statistics of the training table."""
    base = df if training is None else training
    out = zscore_normalize(df, cell_vars, zscore_stats(base, cell_vars, CELL), CELL)
    return zscore_normalize(out, global_vars, zscore_stats(base, global_vars))
