"""From fine fields to pairs of coarse input and fine target."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.columns import CELL
from gridspark.operators.grid import Grid
from gridspark.operators.regrid import remap_bilinear, remap_conservative
from gridspark.operators.reshape import broadcast_static, dry_static_energy, temperature_of
from gridspark.session import tasks_for

# values of variables that a task holds in the tables of its aggregates, unless one time step has more
PLACED_VALUES = 1_000_000


def coarsen_then_refine(df: DataFrame, grid: Grid, factor: int, variables: Sequence[str], temperature: str | None,
                        static: DataFrame, geopotential: str = "z", time: str = "time") -> DataFrame:
    """Fields averaged to a coarse grid and interpolated back, next to the fine originals.

    Temperature travels as dry static energy, together with the geopotential that was regridded the same way,
    so that its height dependence is kept.  Results have the suffixes ``_in`` and ``_tar``; a cell needs both.

    The fields are shuffled once, by time, over as many tasks as their cells ask for: all aggregates of a task stand in memory
    together, several times the size of what it reads, so that the size alone must not join tasks.  Both regriddings work within a time step and keep that placement, and inputs and
    targets meet by grouping instead of a join, which would place them anew.
    """
    coarse = grid.coarsened(factor)
    moved = [*variables, *([geopotential] if temperature else [])]
    # rows without a cell go now, so that the plan needs no filter that would tell the two branches apart
    placed = [F.col(c).isNotNull() for c in CELL]
    cells = df.select(time, *CELL, *variables).where(placed[0] & placed[1])
    fine = cells.repartition(tasks_for(cells, PLACED_VALUES // len(moved)), time)
    work = fine
    if temperature:
        # after the shuffle, so that both branches below read the same one
        work = broadcast_static(fine, static.select(*CELL, geopotential))
        work = work.withColumn(temperature, dry_static_energy(F.col(temperature), F.col(geopotential)))
    low = remap_conservative(work, grid, coarse, moved, [time])
    back = remap_bilinear(low, coarse, grid, moved, [time])
    if temperature:
        back = back.withColumn(temperature, temperature_of(F.col(temperature), F.col(geopotential)))
    names = [f"{v}_in".lower() for v in moved] + [f"{v}_tar".lower() for v in variables]
    inputs = back.withColumnsRenamed({v: f"{v}_in".lower() for v in moved})
    targets = fine.select(time, *CELL, *[F.col(v).alias(f"{v}_tar".lower()) for v in variables])
    met = inputs.withColumn("_side", F.lit(1)).unionByName(targets.withColumn("_side", F.lit(2)), allowMissingColumns=True)
    both = met.groupBy(time, *CELL).agg(*[F.max(c).alias(c) for c in names], F.bit_or("_side").alias("_side"))
    return both.where(F.col("_side") == 3).drop("_side")
