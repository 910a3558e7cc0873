"""Checks and choices on column names, made before any job starts."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

CELL = ("iy", "ix")

# Coordinate names taken as latitude and longitude.
LAT_NAMES = ("rlat", "lat", "latitude")
LON_NAMES = ("rlon", "lon", "longitude")


def missing_names(available: Iterable[str], wanted: Iterable[str]) -> list[str]:
    """Wanted names that are not available, in the order they were asked for."""
    have = set(available)
    return [name for name in wanted if name not in have]


def missing_per_key(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Of all names that the table has anywhere, those that a key lacks: rows ``(keys, name)``.

    The names, of which there are as many as variables, go to the keys as one array.
    """
    present = df.select(*keys, name).where(F.col(name).isNotNull()).distinct()
    names = df.agg(F.sort_array(F.collect_set(name))).scalar()
    return df.select(*keys).distinct().withColumn(name, F.explode(names)).join(present, [*keys, name], "left_anti")


def require(df: DataFrame, names: Iterable[str]) -> None:
    lost = missing_names(df.columns, names)
    if lost:
        raise ValueError(f"columns not in the table: {', '.join(lost)}")


def choose_vars(df: DataFrame, names: Sequence[str] | None = None, suffix: str = "") -> list[str]:
    """The named variables, checked, or every column that ends in ``suffix``."""
    if names is None:
        return [c for c in df.columns if c.endswith(suffix)]
    require(df, names)
    return list(names)


def coordinate(df: DataFrame, known: Sequence[str]) -> str:
    """The first of the known coordinate names that the table has."""
    for name in known:
        if name in df.columns:
            return name
    raise ValueError(f"none of the coordinates {', '.join(known)} is in the table")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing values are NULL everywhere, so aggregates skip them and comparisons are not true."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (DoubleType, FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def one_row(df: DataFrame) -> Column:
    """A one-row table as a struct-valued scalar subquery: computed once, shared by all rows."""
    return df.select(F.struct(*[F.col(c) for c in df.columns])).scalar()


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often and wherever ``body`` uses it.

    Spark may repeat an expression inside a lambda for each element; a lambda variable it never repeats.
    """
    return F.transform(F.array(value), body)[0]


def number_of(text: Column) -> Column:
    """The number that a text stands for, else missing.

    Most texts are words; a look at their characters tells so for less than a cast that fails.
    """
    return F.when(text.rlike("(?i)[0-9]|inf|nan"), text.try_cast("double"))
