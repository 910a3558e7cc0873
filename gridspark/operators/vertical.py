"""Vertical interpolation of model levels to pressure levels, from a pressure column or from hybrid coefficients."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Steps of the search in one column of levels, which holds fewer than twice the first one.
STEPS = (512, 256, 128, 64, 32, 16, 8, 4, 2, 1)


def to_pressure_levels(df: DataFrame, targets: Sequence[float], values: Sequence[str], pressure: str = "p",
                       column: Sequence[str] = ("time", "iy", "ix"), out: str = "plev") -> DataFrame:
    """Values linear in the logarithm of pressure between the two levels around each target; targets beyond
    the outer levels continue the outer segment.  A window holds one vertical column only."""
    up = Window.partitionBy(*column).orderBy(pressure)
    levels = df.where(F.col(pressure).isNotNull())
    named = {"_p1": F.lead(pressure).over(up), "_first": F.row_number().over(up) == 1,
             "_last": F.lead(pressure, 2).over(up).isNull()}
    named |= {f"_{v}1": F.lead(v).over(up) for v in values}
    segments = levels.withColumns(named).where(F.col("_p1").isNotNull())
    wanted = F.array(*[F.lit(float(t)) for t in targets])
    inside = F.filter(wanted, lambda t: (F.col("_first") | (t > F.col(pressure)))
                      & (F.col("_last") | (t <= F.col("_p1"))))
    rows = segments.withColumn(out, F.explode(inside))
    share = F.try_divide(F.ln(F.col(out)) - F.ln(F.col(pressure)), F.ln(F.col("_p1")) - F.ln(F.col(pressure)))
    return rows.select(*column, out, *[
        (F.col(v) + (F.col(f"_{v}1") - F.col(v)) * share).alias(v) for v in values])


def half_coefficients(coefficients: DataFrame, half: str = "half", a: str = "a", b: str = "b") -> Column:
    """The coefficients of all half levels as one array, from the top down: a scalar that every row can use.

    The half levels must be numbered from 0 on without gaps; anything else is an error.
    """
    rows = coefficients.agg(F.array_sort(F.collect_list(F.struct(F.col(half).cast("int").alias("half"), F.col(a).cast("double").alias("a"),
                                                                F.col(b).cast("double").alias("b")))).alias("_c"))
    complete = F.transform("_c", lambda c: c["half"]) == F.sequence(F.lit(0), F.size("_c") - 1)
    odd = F.raise_error(F.lit("half levels must be numbered from 0 on without gaps")).cast(rows.schema["_c"].dataType)
    return rows.select(F.when((F.size("_c") > 1) & complete, F.col("_c")).otherwise(odd)).scalar()


def level_pressure(level: Column, surface: Column, coefficients: Column) -> Column:
    """Pressure in the middle of a model level: the mean of its two half levels ``a + b * surface``; levels are numbered from 1.

    A level without coefficients and a missing surface pressure give a missing pressure.
    """
    upper, lower = F.get(coefficients, (level - 1).cast("int")), F.get(coefficients, level.cast("int"))
    return (upper["a"] + lower["a"] + (upper["b"] + lower["b"]) * surface) / 2


def surface_pressure(log_pressure: Column) -> Column:
    """The surface pressure from its stored logarithm."""
    return F.exp(log_pressure)


def _below(sorted_values: Column, bound: Column) -> Column:
    """How many of the sorted values lie below the bound, by halving."""
    return F.aggregate(F.array(*[F.lit(s) for s in STEPS]), F.lit(0), lambda at, step: F.when(
        (at + step <= F.size(sorted_values)) & (F.get(sorted_values, at + step - 1)["p"] < bound), at + step).otherwise(at))


def hybrid_to_pressure_levels(df: DataFrame, surface: DataFrame, coefficients: DataFrame, targets: Sequence[float], values: Sequence[str],
                              level: str = "level", pressure: str = "sp", column: Sequence[str] = ("time", "iy", "ix"),
                              out: str = "plev") -> DataFrame:
    """Values of hybrid model levels on pressure levels, as ``to_pressure_levels`` has them.

    ``surface`` has the surface pressure of each column, ``coefficients`` the table ``half, a, b``.  The levels of a column are
    gathered once, their pressures follow from the surface pressure, and each target is searched in their order; no window and
    no pressure per level is stored.  A column without surface pressure or with fewer than two levels gives no rows; a missing
    neighbour gives a missing value; columns with more than one surface pressure and repeated levels are errors.
    """
    named = [f"_v{i}" for i in range(len(values))]
    rows = df.where(F.col(level).isNotNull()).select(*column, F.struct(F.col(level).cast("int").alias("k"), *[
        F.col(v).cast("double").alias(n) for v, n in zip(values, named)]).alias("_level"))
    columns = rows.groupBy(*column).agg(F.array_sort(F.collect_list("_level")).alias("_levels"))
    double = F.raise_error(F.lit("a column has more than one surface pressure")).cast("double")
    below = surface.groupBy(*column).agg(F.when(F.count(F.lit(1)) > 1, double).otherwise(F.max(F.col(pressure).cast("double"))).alias("_sp"))
    twice = F.size(F.array_distinct(F.transform("_levels", lambda x: x["k"]))) < F.size("_levels")
    repeated = F.raise_error(F.lit("a column has a level more than once")).cast("double")
    placed = columns.join(below, list(column)).withColumn("_sp", F.when(twice, repeated).otherwise(F.col("_sp")))
    # the coefficients become a column, so that the lambdas below can use them
    known = placed.withColumn("_c", half_coefficients(coefficients))
    levels = F.array_sort(F.filter(F.transform("_levels", lambda x: F.struct(
        level_pressure(x["k"], F.col("_sp"), F.col("_c")).alias("p"), *[x[n].alias(n) for n in named])), lambda x: x["p"].isNotNull()))
    sorted_rows = known.select(*column, levels.alias("_l")).where(F.size("_l") > 1)
    at = sorted_rows.select(*column, "_l", F.explode(F.array(*[F.lit(float(t)) for t in targets])).alias(out))
    first = F.greatest(F.lit(1), F.least(F.size("_l") - 1, _below(F.col("_l"), F.col(out))))
    pairs = at.select(*column, out, F.get("_l", first - 1).alias("_a"), F.get("_l", first).alias("_b"))
    share = F.try_divide(F.ln(F.col(out)) - F.ln("_a.p"), F.ln("_b.p") - F.ln("_a.p"))
    return pairs.select(*column, out, *[
        (F.col(f"_a.{n}") + (F.col(f"_b.{n}") - F.col(f"_a.{n}")) * share).alias(v) for v, n in zip(values, named)])
