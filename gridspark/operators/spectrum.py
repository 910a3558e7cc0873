"""Domain size, detrending and power spectra of fields on a limited area."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspark.columns import nan_to_null
from gridspark.operators.gradient import by_field
from gridspark.operators.grid import Grid
from gridspark.operators.reshape import gather_fields

EARTH_RADIUS = 6378.0e3


def domain_info(df: DataFrame, lat: str = "lat", lon: str = "lon", radius: float = EARTH_RADIUS) -> DataFrame:
    """Number of grid lines, spacing, central latitude and extent of the domain, as one row."""
    deg2m = radius * 2 * math.pi / 360

    def axis(name):
        # one row per grid line
        lines = df.select(F.col(name).alias("c"), F.col("ix" if name == lon else "iy").alias("i")).distinct()
        return lines.agg(F.count(F.lit(1)).alias("n"), F.avg("c").alias("mean"),
                         (F.max(F.when(F.col("i") == 1, F.col("c"))) - F.max(F.when(F.col("i") == 0, F.col("c")))
                          ).alias("d"))

    x = axis(lon).select(F.col("n").alias("nx"), F.col("d").alias("dx"))
    y = axis(lat).select(F.struct("n", "mean", "d")).scalar()
    out = x.select("nx", y["n"].alias("ny"), "dx", y["d"].alias("dy"), y["mean"].alias("lat0"))
    return out.withColumns({
        "lx": F.abs(F.col("nx") * F.col("dx") * deg2m) * F.cos(F.radians("lat0")),
        "ly": F.abs(F.col("ny") * F.col("dy") * deg2m)})


def detrend_field(df: DataFrame, value: str, nx: int, ny: int, time: str = "time", out: str = "detrended") -> DataFrame:
    """Remove the linear change from edge to edge, along x and then along y of the result."""
    def along(v, index, line, n):
        w = Window.partitionBy(*line).orderBy(index).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        slope = (F.last_value(v).over(w) - F.first_value(v).over(w)) / float(n - 1)
        return F.col(v) - 0.5 * slope * (2 * F.col(index) - n)

    flat = by_field(df, Grid(nx, ny, 0.0, 1.0, 0.0, 1.0), time).withColumn("_dx", along(value, "ix", [time, "iy"], nx))
    return flat.withColumn(out, along("_dx", "iy", [time, "ix"], ny)).drop("_dx")


def ring_layout(grid: Grid, radius: float = EARTH_RADIUS) -> tuple[np.ndarray, int]:
    """Ring number of each wavenumber pair ``(ky, kx)`` and the number of complete rings."""
    deg2m = radius * 2 * math.pi / 360
    lat0 = grid.y0 + (grid.ny - 1) / 2 * grid.dy
    dkx = 2 * math.pi / (abs(grid.nx * grid.dx * deg2m) * math.cos(math.radians(lat0)))
    dky = 2 * math.pi / abs(grid.ny * grid.dy * deg2m)
    k = np.sqrt((np.arange(grid.nx) * dkx)[None, :] ** 2 + (np.arange(grid.ny) * dky)[:, None] ** 2)
    return np.round(k / max(dkx, dky)).astype(int), int(np.round(min(grid.nx, grid.ny) / 2 + 0.01))


def power_spectrum(df: DataFrame, values: Sequence[str], grid: Grid, time: str = "time", cutoff: bool = True,
                   radius: float = EARTH_RADIUS) -> DataFrame:
    """Power per ring of total wavenumber, ``(time, variable, k, power)``.

    Fields are gathered once per time and variable, then transformed batch by batch; the power of a ring is
    summed next to the transform, so only a few numbers per field leave it.
    """
    rings, n_complete = ring_layout(grid, radius)
    n_rings = n_complete if cutoff else int(rings.max()) + 1
    ny, nx, flat = grid.ny, grid.nx, rings.ravel()

    # nested, so that it travels with the task and executors need no copy of this package
    def edge_trend(stack, axis):
        n = stack.shape[axis]
        slope = (np.take(stack, [-1], axis) - np.take(stack, [0], axis)) / (n - 1)
        steps = np.expand_dims(2 * np.arange(n) - n, [a for a in range(stack.ndim) if a != axis])
        return 0.5 * slope * steps

    @F.pandas_udf("array<double>")
    def ring_power(fields: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(fields), index=fields.index, dtype=object)
        whole = fields.index[fields.notna()]
        if len(whole) == 0:
            return out
        stack = np.stack(fields[whole].to_numpy()).astype(float).reshape(-1, ny, nx)
        stack = stack - edge_trend(stack, 2)
        stack = stack - edge_trend(stack, 1)
        power = np.abs(np.fft.fft2(stack) / (nx * ny)) ** 2
        for at, p in zip(whole, power):
            out[at] = np.bincount(flat, weights=p.ravel(), minlength=n_rings)[:n_rings]
        return out

    long = df.select(time, "iy", "ix", *values).unpivot([time, "iy", "ix"], list(values), "variable", "_value")
    fields = gather_fields(long, F.col("_value"), nx, ny, [time, "variable"], "_field")
    rows = fields.select(time, "variable", F.posexplode(ring_power("_field")).alias("k", "power"))
    return nan_to_null(rows)


def mean_spectrum(spectra: DataFrame) -> DataFrame:
    """Spectrum averaged over times, per variable."""
    return spectra.groupBy("variable", "k").agg(F.avg("power").alias("power"))
