"""Projections: layouts, names, static variables, derived energy, flips, tensors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.columns import CELL, choose_vars, require
from gridspark.functions.names import level_name

# Specific heat of dry air, gravity, height of the temperature above ground.
CPD, GRAVITY, T_HEIGHT = 1004.709, 9.80665, 2.0

KEYS = ("time", *CELL)


def split_in_tar(df: DataFrame, predictors=None, predictands=None, keys: Sequence[str] = KEYS):
    """Input table and target table, by suffix or by name."""
    return (df.select(*keys, *choose_vars(df, predictors, "_in")),
            df.select(*keys, *choose_vars(df, predictands, "_tar")))


def select_vars(df: DataFrame, names=None, suffix: str = "", keys: Sequence[str] = KEYS) -> DataFrame:
    chosen = [c for c in choose_vars(df, names, suffix) if c not in keys]
    return df.select(*keys, *chosen)


def tar2in(df: DataFrame, target: str, inputs: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """Use a target also as the first input channel."""
    require(df, [target, *inputs])
    return df.select(*keys, F.col(target).alias(f"{target}_as_in"), *inputs, target)


def wide_to_long(df: DataFrame, variables: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    return df.unpivot(list(keys), list(variables), "variable", "value")


def long_to_wide(df: DataFrame, variables: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """One column per named variable; the names are given, so no pass over the data is spent to find them."""
    return df.groupBy(*keys).agg(*[F.first(F.when(F.col("variable") == v, F.col("value")), ignorenulls=True).alias(v)
                                   for v in variables])


def named_targets(df: DataFrame, targets: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    pairs = [x for t in targets for x in (F.lit(t), F.col(t))]
    return df.select(*keys, F.create_map(*pairs).alias("targets"))


def vector_target(df: DataFrame, components: Sequence[str], static: str | None = None,
                  keys: Sequence[str] = KEYS) -> DataFrame:
    """Several targets in one struct, with a static field appended when asked."""
    require(df, components)
    fields = [*components, *([static] if static else [])]
    return df.select(*keys, F.struct(*fields).alias("target"))


def cast_float32(df: DataFrame, variables: Sequence[str]) -> DataFrame:
    return df.withColumns({v: F.col(v).cast("float") for v in variables})


def rename_suffix(df: DataFrame, variables: Sequence[str], suffix: str) -> DataFrame:
    """Append the suffix and use lower case for the new names."""
    require(df, variables)
    return df.withColumnsRenamed({v: (v + suffix).lower() for v in variables})


def levels_to_columns(df: DataFrame, variable: str, levels: Sequence[int], keys: Sequence[str] = KEYS,
                      level: str = "level") -> DataFrame:
    """Level rows (in Pa) as columns such as ``t850``."""
    named = df.select(*keys, level_name(F.lit(variable), F.col(level)).alias("variable"),
                      F.col(variable).alias("value"))
    return long_to_wide(named, [f"{variable}{int(lev / 100)}" for lev in levels], keys)


def rename_coords(df: DataFrame, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Coordinates named ``lat`` and ``lon`` in double precision."""
    names = {lat: "lat", lon: "lon"}
    return df.select(*[F.col(c).cast("double").alias(names[c]) if c in names else c for c in df.columns])


def drop_vars(df: DataFrame, variables: Sequence[str]) -> DataFrame:
    return df.drop(*variables)


def broadcast_static(df: DataFrame, static: DataFrame, on: Sequence[str] = CELL) -> DataFrame:
    """Repeat time-invariant variables over all times; variables already present are left alone.
    The side is one row per cell, and Spark broadcasts it if its measured size allows."""
    new = [c for c in static.columns if c not in df.columns]
    return df.join(static.select(*on, *new), list(on), "left") if new else df


def dry_static_energy(temperature: Column, geopotential: Column) -> Column:
    return CPD * temperature + geopotential + GRAVITY * T_HEIGHT


def temperature_of(energy: Column, geopotential: Column) -> Column:
    return (energy - geopotential - GRAVITY * T_HEIGHT) / CPD


def flip_augment(df: DataFrame, nx: int, ny: int, time: str = "time") -> DataFrame:
    """Four copies: as is, flipped in lat, in lon, in both; copy k is k minutes later so keys stay unique."""
    flips = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(y).alias("fy"), F.lit(x).alias("fx"))
                      for k, (y, x) in enumerate([(False, False), (True, False), (False, True), (True, True)])])
    copies = df.withColumn("_f", F.explode(flips))
    return copies.withColumns({
        time: F.col(time) + F.make_dt_interval(mins=F.col("_f.k")),
        "iy": F.when(F.col("_f.fy"), ny - 1 - F.col("iy")).otherwise(F.col("iy")).cast("int"),
        "ix": F.when(F.col("_f.fx"), nx - 1 - F.col("ix")).otherwise(F.col("ix")).cast("int"),
    }).withColumn("copy", F.col("_f.k")).drop("_f")


def static_flags(df: DataFrame, variables: Sequence[str], on: Sequence[str] = CELL) -> DataFrame:
    """Which variables never change over time at any cell: rows ``(variable, is_static)``."""
    aggs = [F.max(v).alias(f"max_{v}") for v in variables] + [F.min(v).alias(f"min_{v}") for v in variables]
    cells = df.groupBy(*on).agg(*aggs)
    same = cells.agg(*[F.bool_and(F.coalesce(F.col(f"max_{v}") == F.col(f"min_{v}"), F.lit(True))).alias(v)
                       for v in variables])
    return same.unpivot([], list(variables), "variable", "is_static")


def split_static_dynamic(df: DataFrame, static_names: Sequence[str] = ("z", "lsm"), keys: Sequence[str] = KEYS):
    """Table of static variables per cell and table of the others; a static variable that changes is an error."""
    static = [c for c in df.columns if c in static_names]

    def constant(c: str) -> Column:
        changes = F.raise_error(F.lit(f"variable '{c}' is not static")).cast(dict(df.dtypes)[c])
        return F.when(F.min(c) < F.max(c), changes).otherwise(F.max(c)).alias(c)

    fixed = df.groupBy(*[k for k in keys if k != "time"]).agg(*[constant(c) for c in static])
    return fixed, df.drop(*static)


def field_tensor(df: DataFrame, predictors: Sequence[str], predictands: Sequence[str], nx: int, ny: int,
                 time: str = "time") -> DataFrame:
    """One row per time with the field as rows of cells, each an array of channels, predictors first.

    A field holds at most one entry per cell of the grid: cells are made unique before they are gathered,
    and a second value for a cell is an error.
    """
    channels = [*predictors, *predictands]
    return gather_fields(df, F.array(*[F.col(c).cast("float") for c in channels]), nx, ny, [time], "tensor")


def gather_fields(df: DataFrame, value: Column, nx: int, ny: int, keys: Sequence[str], out: str) -> DataFrame:
    """Arrays of a value in row-major cell order, one per key; a field with missing cells is NULL.

    A cell outside the grid is an error.
    """
    place = in_grid(nx, ny, (F.col("iy") * nx + F.col("ix")).cast("int"), "int")
    cells = (df.select(*keys, place.alias("_pos"), value.alias("_v")).repartition(*keys)
             .groupBy(*keys, "_pos").agg(F.any_value("_v").alias("_v"), F.count(F.lit(1)).alias("_n")))
    single = F.when(F.col("_n") == 1, F.col("_v")).otherwise(
        F.raise_error(F.lit("a cell has more than one value at a time")).cast(value_type(df, value)))
    gathered = cells.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("_pos", single.alias("v")))).alias("_cells"))
    field = F.when(F.size("_cells") == nx * ny, F.transform("_cells", lambda c: c["v"]))
    return gathered.select(*keys, field.alias(out))


def in_grid(nx: int, ny: int, value: Column, kind: str) -> Column:
    """The value; a cell outside the grid of ``nx`` by ``ny`` cells is an error that names it."""
    inside = F.col("iy").between(0, ny - 1) & F.col("ix").between(0, nx - 1)
    cell = F.concat_ws(", ", F.coalesce(F.col("iy").cast("string"), F.lit("NULL")), F.coalesce(F.col("ix").cast("string"), F.lit("NULL")))
    lost = F.raise_error(F.concat(F.lit(f"a cell lies outside the grid of {ny}x{nx} cells: "), cell)).cast(kind)
    return F.when(inside, value).otherwise(lost)


def value_type(df: DataFrame, value: Column) -> str:
    return df.select(value.alias("v")).schema["v"].dataType.simpleString()
