"""Grid descriptions and the cell tables made from them."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.functions.sphere import to_geographic


@dataclass(frozen=True)
class Grid:
    """A regular grid: sizes, centre of the first cell, spacing (which may be negative).

    With ``pole``, the geographic latitude and longitude of its north pole, the coordinates are those of a rotated system.
    """

    nx: int
    ny: int
    x0: float
    dx: float
    y0: float
    dy: float
    pole: tuple[float, float] | None = None

    @property
    def cyclic(self) -> bool:
        """Whether the last cell of a line meets the first one."""
        return abs(self.nx * abs(self.dx) - 360.0) < 1e-6

    def coarsened(self, factor: int) -> Grid:
        """Every ``factor`` x ``factor`` cells become one, over the same area."""
        if self.nx % factor or self.ny % factor:
            raise ValueError(f"{self.nx}x{self.ny} cells cannot be divided by {factor}")
        shift = (factor - 1) / 2
        return replace(self, nx=self.nx // factor, ny=self.ny // factor, x0=self.x0 + shift * self.dx, dx=self.dx * factor,
                       y0=self.y0 + shift * self.dy, dy=self.dy * factor)

    def padded(self, factor: int) -> tuple[Grid, Grid]:
        """The fine grid with one coarse cell more on each side, and its coarsened form."""
        if self.nx % factor or self.ny % factor:
            raise ValueError(f"{self.nx}x{self.ny} cells cannot be divided by {factor}")
        base = replace(self, nx=self.nx + 2 * factor, ny=self.ny + 2 * factor,
                       x0=self.x0 - factor * self.dx, y0=self.y0 - factor * self.dy)
        return base, base.coarsened(factor)

    def box(self, digits: int = 4) -> tuple[float, float, float, float]:
        """Lon and lat bounds that hold all cell centres but no cell beyond them."""
        return (*axis_bounds(self.x0, self.dx, self.nx, digits), *axis_bounds(self.y0, self.dy, self.ny, digits))


def axis_bounds(first: float, step: float, n: int, digits: int = 4) -> tuple[float, float]:
    ends = round(float(first), digits), round(float(first) + (int(n) - 0.5) * float(step), digits)
    return min(ends), max(ends)


def coarsen_table(df: DataFrame, factor: int, extrapolate: bool = False) -> DataFrame:
    """Coarse (and, unless extrapolating later, padded base) descriptions for a table of grid descriptions
    with columns ``xsize, ysize, xfirst, xinc, yfirst, yinc``; sizes that do not divide are an error."""
    divides = (F.col("xsize") % factor == 0) & (F.col("ysize") % factor == 0)
    checked = F.when(divides, F.col("xsize")).otherwise(
        F.raise_error(F.concat(F.lit(f"grid sizes must be divisible by {factor}: "),
                               F.concat_ws("x", "xsize", "ysize"))).cast("bigint"))
    more, shift = (0, (factor - 1) / 2) if extrapolate else (2, -(factor + 1) / 2)
    new = {
        "coarse_xsize": F.floor(checked / factor) + more,
        "coarse_ysize": F.floor(F.col("ysize") / factor) + more,
        "coarse_xfirst": F.col("xfirst") + shift * F.col("xinc"),
        "coarse_xinc": F.col("xinc") * factor,
        "coarse_yfirst": F.col("yfirst") + shift * F.col("yinc"),
        "coarse_yinc": F.col("yinc") * factor,
    }
    if not extrapolate:
        new |= {
            "base_xsize": F.col("xsize") + 2 * factor,
            "base_ysize": F.col("ysize") + 2 * factor,
            "base_xfirst": F.col("xfirst") - factor * F.col("xinc"),
            "base_yfirst": F.col("yfirst") - factor * F.col("yinc"),
        }
    return df.withColumns(new)


POLE = ("grid_north_pole_latitude", "grid_north_pole_longitude")


def expand_cells(df: DataFrame) -> DataFrame:
    """Cell centres and edges of every grid description in a table.

    Where a description has the columns of a rotated pole, centres and edges are in its own system, and ``geo_lat`` and
    ``geo_lon`` are the geographic place of the centre; they are the same where the pole is missing.
    """
    rows = df.withColumn("iy", F.explode(F.sequence(F.lit(0), (F.col("ysize") - 1).cast("int"))))
    cells = rows.withColumn("ix", F.explode(F.sequence(F.lit(0), (F.col("xsize") - 1).cast("int"))))
    lat, lon = F.col("yfirst") + F.col("iy") * F.col("yinc"), F.col("xfirst") + F.col("ix") * F.col("xinc")
    half_y, half_x = F.abs("yinc") / 2, F.abs("xinc") / 2
    placed = cells.withColumns({
        "lat": lat, "lon": lon, "lat_lo": lat - half_y, "lat_hi": lat + half_y,
        "lon_lo": lon - half_x, "lon_hi": lon + half_x})
    if not all(c in df.columns for c in POLE):
        return placed
    turned = F.col(POLE[0]).isNotNull() & F.col(POLE[1]).isNotNull()
    there = to_geographic(F.col("lat"), F.col("lon"), F.col(POLE[0]), F.col(POLE[1]))
    return placed.withColumns({f"geo_{c}": F.when(turned, at).otherwise(F.col(c)) for c, at in zip(("lat", "lon"), there)})


def grid_row(spark: SparkSession, grid: Grid) -> DataFrame:
    pole = [] if grid.pole is None else [F.lit(float(v)).alias(c) for c, v in zip(POLE, grid.pole)]
    return spark.range(1).select(
        F.lit(grid.nx).alias("xsize"), F.lit(grid.ny).alias("ysize"), F.lit(float(grid.x0)).alias("xfirst"),
        F.lit(float(grid.dx)).alias("xinc"), F.lit(float(grid.y0)).alias("yfirst"),
        F.lit(float(grid.dy)).alias("yinc"), *pole)


def grid_cells(spark: SparkSession, grid: Grid) -> DataFrame:
    return expand_cells(grid_row(spark, grid)).drop("xsize", "ysize", "xfirst", "xinc", "yfirst", "yinc", *POLE)


def in_box(lon: Column, lat: Column, box: tuple[float, float, float, float]) -> Column:
    """Inside a lon/lat box; plain column bounds, so that they reach the Parquet scan.

    Longitudes that differ by 360 degrees are the same, so a box may lie across the zero or date meridian of the table.
    """
    x0, x1, y0, y1 = box
    inside = (lon >= x0) & (lon <= x1)
    for turn in (-360.0, 360.0):
        inside = inside | ((lon >= x0 + turn) & (lon <= x1 + turn))
    return inside & (lat >= y0) & (lat <= y1)
