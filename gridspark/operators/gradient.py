"""Derivatives along coordinates and the gradient amplitude on the sphere."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.columns import require
from gridspark.operators.grid import Grid

EARTH_RADIUS = 6371.0e3

# Fields up to this many cells are handled in one task.
FIELD_CELLS = 2_000_000


def centered_difference(value: Column, coord: Column, index: str, line: Sequence[str]) -> Column:
    """Second-order derivative along a possibly uneven coordinate, first order at both ends.

    ``line`` are the keys of one grid line and ``index`` the position on it.  A missing neighbour inside the
    line makes the result NULL.
    """
    w = Window.partitionBy(*line).orderBy(index)
    i = F.col(index)
    up, down = F.lead(value).over(w), F.lag(value).over(w)
    h_up, h_down = F.lead(coord).over(w) - coord, coord - F.lag(coord).over(w)
    has_up, has_down = F.lead(i).over(w), F.lag(i).over(w)
    inner = F.try_divide(h_down * h_down * up + (h_up * h_up - h_down * h_down) * value - h_up * h_up * down,
                         h_up * h_down * (h_up + h_down))
    return (F.when(has_up.isNull() & has_down.isNull(), F.lit(None).cast("double"))
            .when(has_down.isNull(), F.when(has_up == i + 1, F.try_divide(up - value, h_up)))
            .when(has_up.isNull(), F.when(has_down == i - 1, F.try_divide(value - down, h_down)))
            .when((has_up == i + 1) & (has_down == i - 1), inner))


def by_field(df: DataFrame, grid: Grid | None, time: str, together: bool | None = None) -> DataFrame:
    """Bring each field together once, so that windows along both axes and sums per field share one shuffle.

    ``together`` says whether a field fits into a task; left open, it does where the grid is known and has at most
    ``FIELD_CELLS`` cells.  Otherwise the windows spread the lines of a field.
    """
    if together is None:
        together = grid is not None and grid.nx * grid.ny <= FIELD_CELLS
    return df.repartition(time) if together else df


def _degrees(x: float | Column) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def gradient_amplitude(df: DataFrame, values: Sequence[str], dlon: float | Column, dlat: float | Column, lat: str = "lat",
                       lon: str = "lon", time: str = "time", si: bool = False,
                       radius: float = EARTH_RADIUS, keys: Sequence[str] = ()) -> DataFrame:
    """Amplitude of the gradient of each variable in each cell, as ``grad_<var>``; ``dlon`` and ``dlat`` are
    the grid spacings in degrees, ``keys`` further dimensions of the table (members, levels).

    The derivative per degree is divided by the spacing in metres; with ``si`` it is per metre instead.
    """
    step_x, step_y = (F.radians(F.lit(1.0)),) * 2 if si else (F.radians(_degrees(dlon)), F.radians(_degrees(dlat)))
    per_x, per_y = radius * F.cos(F.radians(lat)) * step_x, radius * step_y
    # all variables along one axis before the other: one arrangement of the rows per axis
    along_x = df.withColumns({f"_gx_{v}": centered_difference(F.col(v), F.col(lon), "ix", [*keys, time, "iy"]) / per_x
                              for v in values})
    both = along_x.withColumns({f"_gy_{v}": centered_difference(F.col(v), F.col(lat), "iy", [*keys, time, "ix"]) / per_y
                                for v in values})
    return both.withColumns({f"grad_{v}": F.sqrt(F.col(f"_gx_{v}") ** 2 + F.col(f"_gy_{v}") ** 2)
                             for v in values}).drop(*[f"_g{a}_{v}" for a in "xy" for v in values])


def spatial_gradient(df: DataFrame, values: Sequence[str], dlon: float | Column, dlat: float | Column, time: str = "time",
                     grid: Grid | None = None, keys: Sequence[str] = (), together: bool | None = None, **kw) -> DataFrame:
    """Mean gradient amplitude of each variable per time and ``keys``."""
    out = gradient_amplitude(by_field(df, grid, time, together), values, dlon, dlat, time=time, keys=keys, **kw)
    return out.groupBy(*keys, time).agg(*[F.avg(f"grad_{v}").alias(f"grad_{v}") for v in values])


def grid_of(df: DataFrame, lat: str = "lat", lon: str = "lon") -> Grid | None:
    """The grid that a table covers, from its indices and coordinates in one pass; none for an empty table.

    Axes of a single cell have no spacing, which is NaN.
    """
    def axis(coord: str, index: str) -> list[Column]:
        return [F.min(index), F.max(index), F.min_by(coord, index).cast("double"), F.max_by(coord, index).cast("double")]

    row = df.agg(*[c.alias(f"c{i}") for i, c in enumerate([*axis(lon, "ix"), *axis(lat, "iy")])]).first()
    if row is None or None in tuple(row):
        return None
    (i0, i1, x0, x1), (j0, j1, y0, y1) = row[:4], row[4:]
    return Grid(i1 - i0 + 1, j1 - j0 + 1, x0, (x1 - x0) / (i1 - i0) if i1 > i0 else float("nan"),
                y0, (y1 - y0) / (j1 - j0) if j1 > j0 else float("nan"))


def amplitude_ratio(df: DataFrame, by: Sequence[str] = ("time",), dlon: float | None = None, dlat: float | None = None,
                    time: str = "time", order: int = 1, fcst: str = "fcst", ref: str = "ref_", grid: Grid | None = None,
                    lat: str = "lat", lon: str = "lon", **kw) -> DataFrame:
    """Gradient amplitude of the forecast over that of the reference per time, averaged per ``by``.

    Spacings that are not given come from the grid, or else from the coordinates, which are then read once at the call and also
    tell whether a field fits into a task.  ``by`` may hold the time, columns that follow from it, and further dimensions, whose
    fields are kept apart.
    """
    if order != 1:
        raise ValueError("only first-order differences are implemented")
    require(df, by)
    if grid is None and (dlon is None or dlat is None):
        grid = grid_of(df, lat, lon)
    dlon = dlon if dlon is not None else abs(grid.dx) if grid is not None else 1.0
    dlat = dlat if dlat is not None else abs(grid.dy) if grid is not None else 1.0
    keys = [c for c in by if c != time]
    grads = spatial_gradient(df, [fcst, ref], dlon, dlat, time, grid=grid, keys=keys, lat=lat, lon=lon, **kw)
    ratio = grads.select(*keys, time, F.try_divide(F.col(f"grad_{fcst}"), F.col(f"grad_{ref}")).alias("grad_amplitude"))
    return ratio if time in by else ratio.groupBy(*keys).agg(F.avg("grad_amplitude").alias("grad_amplitude"))
