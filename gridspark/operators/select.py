"""Filters: boxes, hours, seasons, splits, levels, leads, missing values, complete times."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.columns import CELL
from gridspark.functions.calendar import extract_date, season_months
from gridspark.functions.names import natural_key
from gridspark.functions.ranking import row_numbers, time_ranks
from gridspark.operators.grid import in_box
from gridspark.session import stored

# Lon and lat bounds of the default region in degrees.
DEFAULT_BOX = (0.0, 30.0, 30.0, 60.0)


def sel_lonlat_box(df: DataFrame, box=DEFAULT_BOX, lon: str = "lon", lat: str = "lat") -> DataFrame:
    return df.where(in_box(F.col(lon), F.col(lat), box))


def sel_hours(df: DataFrame, hours: Iterable[int], time: str = "time") -> DataFrame:
    return df.where(F.hour(time).isin(*hours))


def sel_season(df: DataFrame, season: str, time: str = "time") -> DataFrame:
    return df.where(F.month(time).isin(*season_months(season)))


def split_label(time: Column, splits: dict[str, list[tuple[Sequence[int], Sequence[int] | None]]]) -> Column:
    """Name of the split of a time: each split lists (years, months or None); the first match wins.
    A time that belongs to no split is an error, so the splits are exhaustive."""
    label = None
    for name, parts in splits.items():
        for years, months in parts:
            cond = F.year(time).isin(*years)
            if months is not None:
                cond = cond & F.month(time).isin(*months)
            label = F.when(cond, name) if label is None else label.when(cond, name)
    lost = F.raise_error(F.concat(F.lit("time in no split: "), time.cast("string"))).cast("string")
    return label.otherwise(lost)


def sel_level(df: DataFrame, levels: Iterable[float], level: str = "level") -> DataFrame:
    return df.where(F.col(level).isin(*levels))


def sel_leadtime(df: DataFrame, first: int = 0, last: int = 11, lead: str = "lead") -> DataFrame:
    return df.where(F.col(lead).between(first, last))


def cap_samples(df: DataFrame, n: int, time: str = "time") -> DataFrame:
    """The cells of the first ``n`` distinct time steps."""
    first = time_ranks(df.select(time).distinct(), time).where(F.col("rn") <= n)
    return df.join(stored(first.select(time), "first-times"), time, "left_semi")


def drop_missing_zero(df: DataFrame, value: str, drop_zero: bool = True) -> DataFrame:
    kept = df.where(F.col(value).isNotNull() & ~F.isnan(value))
    return kept.where(F.col(value) > 0) if drop_zero else kept


def complete_times(df: DataFrame, pieces: Sequence[str], n_pieces: int, time: str = "time") -> DataFrame:
    """Keep a time step only if all of its pieces are there."""
    whole = (df.select(time, *pieces).distinct().groupBy(time).agg(F.count(F.lit(1)).alias("n"))
             .where(F.col("n") == n_pieces))
    return df.join(stored(whole.select(time), "whole-times"), time, "left_semi")


def start_cutoff(df: DataFrame, start: str, time: str = "time") -> DataFrame:
    """Drop time steps at or before the cut-off."""
    return df.where(F.col(time) > F.lit(start).cast("timestamp_ntz"))


def subset_files_on_date(df: DataFrame, value: int, name: str = "fname", part: str = "HH") -> DataFrame:
    """Files whose date, read from the name, has the given part; an empty result is an error."""
    kept = df.where(F.date_format(extract_date(F.col(name)), part) == f"{int(value):02d}")
    if kept.isEmpty():
        raise ValueError(f"no file carries {int(value):02d} as '{part}' of its date")
    return kept


def natural_order(df: DataFrame, name: str = "fname") -> DataFrame:
    """Position of each file when sorted by the first integer of its name; equal ones are sorted by the second
    integer and then by name."""
    keyed = df.withColumns({"order_key": natural_key(F.col(name)), "_second": natural_key(F.col(name), 1)})
    bucket = F.struct("order_key", F.floor(F.col("_second") / 1000))
    ranked = row_numbers(keyed, bucket, [F.col("order_key"), F.col("_second"), F.col(name)], out="pos")
    return ranked.drop("_second")


def sel_matching_coords(df: DataFrame, other: DataFrame, on: Sequence[str] = CELL) -> DataFrame:
    """Cells whose coordinates exist in another grid."""
    return df.join(other.select(*on).distinct(), list(on), "left_semi")


def first_sample(df: DataFrame, time: str = "time") -> DataFrame:
    """The cells of the earliest time step."""
    return df.where(F.col(time) == df.agg(F.min(time)).scalar())
