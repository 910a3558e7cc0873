"""Joins that align tables on time, cells and forecast runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.columns import CELL
from gridspark.functions.calendar import forecast_run
from gridspark.functions.ranking import time_ranks
from gridspark.session import stored

KEYS = ("time", *CELL)


def time_intersection(a: DataFrame, b: DataFrame, time: str = "time") -> DataFrame:
    return a.select(time).intersect(b.select(time))


def merge_on_time_intersection(a: DataFrame, b: DataFrame, on: Sequence[str] = KEYS) -> DataFrame:
    """Both tables' variables at their common times and cells; no common time is an error.

    The check reads the time columns only.
    """
    time = on[0]
    if a.select(time).distinct().join(b.select(time).distinct(), time, "left_semi").isEmpty():
        raise ValueError("the tables have no time in common")
    return a.join(b, list(on))


def merge_variables(a: DataFrame, b: DataFrame, on: Sequence[str] = KEYS) -> DataFrame:
    """All keys of both tables with the variables of both; where both carry a variable the first wins."""
    shared = [c for c in a.columns if c in b.columns and c not in on]
    other = b.withColumnsRenamed({c: f"_second_{c}" for c in shared})
    joined = a.join(other, list(on), "full_outer")
    for c in shared:
        joined = joined.withColumn(c, F.coalesce(c, f"_second_{c}")).drop(f"_second_{c}")
    return joined


def merge_time_union(*parts: DataFrame, time: str = "time") -> DataFrame:
    """Pieces of the same variables one after another, in time order across the whole table."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    # cells of one time may lie in several partitions
    order = [time, *[c for c in CELL if c in out.columns]]
    return out.repartitionByRange(*order).sortWithinPartitions(*order)


def append_purpose(**parts: DataFrame) -> DataFrame:
    """Named tables (train, val, test) as one collection with a ``purpose`` column."""
    out = None
    for name, df in parts.items():
        labelled = df.withColumn("purpose", F.lit(name))
        out = labelled if out is None else out.unionByName(labelled)
    return out


def align_fcst_ref(fcst: DataFrame, ref: DataFrame, on: Sequence[str] = KEYS, value: str = "value") -> DataFrame:
    """Forecast next to reference on the labels they share; both must have the same columns in the same order."""
    if fcst.columns != ref.columns:
        raise ValueError(f"columns must match, but got [{', '.join(fcst.columns)}] vs. [{', '.join(ref.columns)}]")
    return (fcst.withColumnRenamed(value, "fcst").join(ref.withColumnRenamed(value, "ref_"), list(on)))


def climatology(df: DataFrame, value: str, by: Sequence[str] = CELL, out: str = "clim") -> DataFrame:
    return df.groupBy(*by).agg(F.avg(value).alias(out))


def anomalies(df: DataFrame, clim: DataFrame, values: Sequence[str], on: Sequence[str] = CELL) -> DataFrame:
    """Values minus the climatology of their cell."""
    joined = df.join(stored(clim, "climatology"), list(on))
    return joined.withColumns({f"{v}_ano": F.col(v) - F.col("clim") for v in values})


def forecast_lookup(valid: DataFrame, runs: DataFrame, model: str = "era5", offset: int = 6,
                    time: str = "time", on: Sequence[str] = CELL) -> DataFrame:
    """The forecast that serves each valid time, found by its run start and lead."""
    keyed = valid.withColumns(forecast_run(F.col(time), model, offset))
    return keyed.join(runs, ["run_init", "lead", *on])


def attach_coords(df: DataFrame, field: str, nx: int, coords: DataFrame, stats: DataFrame, z_branch: bool = False,
                  keys: Sequence[str] = ("time",), out: str = "value") -> DataFrame:
    """Model output arrays as rows with their coordinates, back in physical units.

    ``field`` is an array of cells, or of channel arrays of which the first is used when the model also
    predicts a static field.
    """
    rows = df.select(*keys, F.posexplode(field).alias("_pos", "_v"))
    value = F.col("_v")[0] if z_branch else F.col("_v")
    cells = rows.select(*keys, F.floor(F.col("_pos") / nx).cast("int").alias("iy"),
                        (F.col("_pos") % nx).cast("int").alias("ix"), value.alias("_v"))
    stat = stats.select(F.struct("mu", "sigma")).scalar()
    return (cells.join(coords, list(CELL)).withColumn(out, F.col("_v") * stat["sigma"] + stat["mu"]).drop("_v"))


def compare_experiments(scores: DataFrame, names: Sequence[str], value: str, by: Sequence[str] = ("hour",)) -> DataFrame:
    """Experiments side by side, with the difference of the last to the first."""
    cols = [F.max(F.when(F.col("exp") == n, F.col(value))).alias(f"{value}_{n}") for n in names]
    wide = scores.groupBy(*by).agg(*cols)
    return wide.withColumn("difference", F.col(f"{value}_{names[-1]}") - F.col(f"{value}_{names[0]}"))


def sort_time(df: DataFrame, time: str = "time", out: str = "pos") -> DataFrame:
    """Position of each row's time step on the sorted axis of distinct steps; rows of one step share it.

    Only the steps are ranked, so a table of cells is not sorted.
    """
    steps = stored(df.select(time).distinct(), "steps")
    return df.join(stored(time_ranks(steps, time, out=out), "positions"), time).select(*df.columns, out)
