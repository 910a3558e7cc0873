"""Conservative and bilinear regridding with a weight table per pair of grids.

The weights depend on the two grids only.  Along each axis the source cells that a target cell touches follow
from arithmetic on the indices, so no range join is needed; the data meets the weights in one equi-join.  The weights
are stored first, so that Spark knows their size and sends them to the data only if they are small.

Grids with different poles have no common axes.  Bilinear weights then follow from the same arithmetic on the target's centres in
the coordinates of the source, conservative ones from clipping cells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.functions.sphere import to_geographic, to_rotated
from gridspark.operators.clipping import clipped_weights
from gridspark.operators.grid import Grid
from gridspark.session import stored


# How the indices of an axis go on at its ends: not at all, after a turn of the globe, or around the globe.
PLAIN, TURNED, CYCLIC = 0, 1, 2


def _along_x(grid: Grid) -> int:
    return CYCLIC if grid.cyclic else TURNED


def _centre(index: Column, src, dst, ends: int) -> Column:
    """Coordinate of the target cell, for longitudes in the turn that is nearest to the source."""
    t0, td = dst
    return _turned(F.lit(t0) + index * td, src, ends)


def _turned(centre: Column, src, ends: int) -> Column:
    """The coordinate, for longitudes in the turn that is nearest to the source."""
    sn, s0, sd = src
    if ends == PLAIN:
        return centre
    middle = s0 + (sn - 1) / 2 * sd
    return centre - 360.0 * F.round((centre - middle) / 360.0)


def _overlaps(index: Column, src, dst, measure, ends: int = PLAIN) -> Column:
    """Source cells along one axis that the target cell touches: array of (source index, common size)."""
    (sn, s0, sd), (t0, td) = src, dst
    centre = _centre(index, src, dst, ends)
    t_lo, t_hi = centre - abs(td) / 2, centre + abs(td) / 2
    bounds = (t_lo - s0) / sd, (t_hi - s0) / sd
    first, last = F.floor(F.least(*bounds)), F.ceil(F.greatest(*bounds))
    if ends != CYCLIC:
        first, last = F.greatest(first, F.lit(0)), F.least(last, F.lit(sn - 1))
    first, last = first.cast("int"), last.cast("int")

    def pair(s):
        lo = F.greatest(t_lo, s0 + s * sd - abs(sd) / 2)
        hi = F.least(t_hi, s0 + s * sd + abs(sd) / 2)
        return F.struct(F.pmod(s, F.lit(sn)).alias("s"), F.when(hi - lo > 1e-12, measure(lo, hi)).alias("w"))

    cells = F.when(last >= first, F.transform(F.sequence(first, last), pair))
    return F.filter(cells, lambda c: c["w"].isNotNull())


def _neighbours(centre: Column, src, extrapolate: bool, ends: int = PLAIN) -> Column:
    """The two source indices around a target centre along one axis and their linear weights."""
    sn, s0, sd = src
    f = (centre - s0) / sd
    if ends == CYCLIC:
        i0 = F.floor(f).cast("int")
        pairs = F.array(F.struct(F.pmod(i0, F.lit(sn)).alias("s"), (1 - (f - i0)).alias("w")),
                        F.struct(F.pmod(i0 + 1, F.lit(sn)).alias("s"), (f - i0).alias("w")))
        return F.filter(pairs, lambda c: c["w"] != 0)
    if not extrapolate:
        f = F.greatest(F.lit(0.0), F.least(F.lit(float(sn - 1)), f))
    i0 = F.greatest(F.lit(0), F.least(F.lit(max(sn - 2, 0)), F.floor(f).cast("int")))
    pairs = F.array(F.struct(i0.alias("s"), (1 - (f - i0)).alias("w")),
                    F.struct((i0 + 1).alias("s"), (f - i0).alias("w")))
    return F.filter(pairs, lambda c: (c["s"] < sn) & (c["w"] != 0))


def _cells(spark: SparkSession, dst: Grid) -> DataFrame:
    return spark.range(dst.nx * dst.ny).select(
        F.floor(F.col("id") / dst.nx).cast("int").alias("ty"), (F.col("id") % dst.nx).cast("int").alias("tx"))


def _products(cells: DataFrame, along_x: Column, along_y: Column) -> DataFrame:
    """Every target cell with its source cells; the weight of a cell is the product over the axes."""
    pairs = cells.withColumn("y", F.explode(along_y)).withColumn("x", F.explode(along_x))
    return pairs.select(F.col("y.s").alias("iy"), F.col("x.s").alias("ix"), "ty", "tx",
                        (F.col("y.w") * F.col("x.w")).alias("w"))


def conservative_weights(spark: SparkSession, src: Grid, dst: Grid) -> DataFrame:
    """``(iy, ix)`` of the source, ``(ty, tx)`` of the target and their common area on the sphere.

    Cells of grids with the same pole are bounded by circles of latitude, those of grids with different poles by great circles
    between their corners.
    """
    if src.pole != dst.pole:
        return clipped_weights(spark, src, dst)
    return _products(
        _cells(spark, dst),
        _overlaps(F.col("tx"), (src.nx, src.x0, src.dx), (dst.x0, dst.dx), lambda lo, hi: F.radians(hi) - F.radians(lo), _along_x(src)),
        _overlaps(F.col("ty"), (src.ny, src.y0, src.dy), (dst.y0, dst.dy),
                  lambda lo, hi: F.sin(F.radians(hi)) - F.sin(F.radians(lo))))


def _centres(cells: DataFrame, src: Grid, dst: Grid) -> DataFrame:
    """The target cells with their centres ``cx, cy`` in the coordinates of the source."""
    x, y = (src.nx, src.x0, src.dx), (src.ny, src.y0, src.dy)
    if src.pole == dst.pole:
        return cells.withColumns({"cx": _centre(F.col("tx"), x, (dst.x0, dst.dx), _along_x(src)),
                                  "cy": _centre(F.col("ty"), y, (dst.y0, dst.dy), PLAIN)})
    lat, lon = F.lit(dst.y0) + F.col("ty") * dst.dy, F.lit(dst.x0) + F.col("tx") * dst.dx
    if dst.pole is not None:
        lat, lon = to_geographic(lat, lon, *(F.lit(float(p)) for p in dst.pole))
    if src.pole is not None:
        lat, lon = to_rotated(lat, lon, *(F.lit(float(p)) for p in src.pole))
    return cells.withColumns({"cx": _turned(lon, x, _along_x(src)), "cy": lat})


def bilinear_weights(spark: SparkSession, src: Grid, dst: Grid, extrapolate: bool = True) -> DataFrame:
    """Up to four source neighbours per target cell."""
    return _products(
        _centres(_cells(spark, dst), src, dst),
        _neighbours(F.col("cx"), (src.nx, src.x0, src.dx), extrapolate, _along_x(src)),
        _neighbours(F.col("cy"), (src.ny, src.y0, src.dy), extrapolate))


def without_source(df: DataFrame, weights: DataFrame, dst: Grid, values: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Target cells that touch no source cell, missing at each key of the table, so that target fields are complete."""
    ids = F.explode(F.sequence(F.lit(0), F.lit(dst.nx * dst.ny - 1)))
    cells = df.select(*keys).distinct().select(*keys, ids.alias("_id"))
    touched = weights.select((F.col("ty") * dst.nx + F.col("tx")).alias("_id")).distinct()
    return cells.join(touched, "_id", "left_anti").select(
        *keys, F.floor(F.col("_id") / dst.nx).cast("int").alias("iy"), (F.col("_id") % dst.nx).cast("int").alias("ix"),
        *[F.lit(None).cast("double").alias(v) for v in values])


def covers(src: Grid, dst: Grid) -> bool:
    """Whether all target cells surely touch source cells, by the outer bounds of the grids."""
    if src.pole != dst.pole:
        return False

    def inside(s0, sd, sn, t0, td, tn):
        half = (abs(sd) + abs(td)) / 2
        s, t = sorted((s0, s0 + (sn - 1) * sd)), sorted((t0, t0 + (tn - 1) * td))
        return t[0] > s[0] - half + 1e-9 and t[1] < s[1] + half - 1e-9
    x = src.cyclic or inside(src.x0, src.dx, src.nx, dst.x0, dst.dx, dst.nx)
    return x and inside(src.y0, src.dy, src.ny, dst.y0, dst.dy, dst.ny)


def apply_weights(df: DataFrame, weights: DataFrame, values: Sequence[str],
                  keys: Sequence[str] = ("time",), renormalise: bool = True) -> DataFrame:
    """Weighted values on the target cells.

    With ``renormalise`` a missing source cell takes its own weight out of the mean (conservative);
    without it a target with any missing neighbour is missing (bilinear).
    """
    joined = df.select(*keys, "iy", "ix", *values).join(weights, ["iy", "ix"])
    aggs = []
    for v in values:
        total = F.sum(F.col("w") * F.col(v))
        if renormalise:
            value = F.try_divide(total, F.sum(F.when(F.col(v).isNotNull(), F.col("w"))))
        else:
            # the weights of a complete target add up to one
            value = F.when(F.abs(F.sum(F.when(F.col(v).isNotNull(), F.col("w"))) - 1) < 1e-9, total)
        aggs.append(value.alias(v))
    out = joined.groupBy(*keys, "ty", "tx").agg(*aggs)
    return out.withColumnsRenamed({"ty": "iy", "tx": "ix"})


def remap_conservative(df: DataFrame, src: Grid, dst: Grid, values: Sequence[str],
                       keys: Sequence[str] = ("time",)) -> DataFrame:
    """Means by common area; a target cell that touches no source cell is missing."""
    weights = stored(conservative_weights(df.sparkSession, src, dst), "weights")
    out = apply_weights(df, weights, values, keys)
    return out if covers(src, dst) else out.unionByName(without_source(df, weights, dst, values, keys))


def remap_bilinear(df: DataFrame, src: Grid, dst: Grid, values: Sequence[str],
                   keys: Sequence[str] = ("time",), extrapolate: bool = True) -> DataFrame:
    weights = stored(bilinear_weights(df.sparkSession, src, dst, extrapolate), "weights")
    return apply_weights(df, weights, values, keys, renormalise=False)
