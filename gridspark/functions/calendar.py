"""Calendar columns: seasons, month axes, forecast runs, dates inside names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Months of each season code.
SEASON_MONTHS = {
    "DJF": [12, 1, 2],
    "MAM": [3, 4, 5],
    "MMA": [3, 4, 5],
    "JJA": [6, 7, 8],
    "SON": [9, 10, 11],
    "summer": [4, 5, 6, 7, 8, 9],
    "winter": [1, 2, 3, 10, 11, 12],
    "all": [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12],
}

# Daily start hours of the forecast models.
RUN_HOURS = {"era5": (6, 18), "ifs": (0, 12)}


def season_months(code: str) -> list[int]:
    if code not in SEASON_MONTHS:
        raise ValueError(f"unknown season '{code}', known: {', '.join(SEASON_MONTHS)}")
    return SEASON_MONTHS[code]


def season_of(time: Column) -> Column:
    month = F.month(time)
    return (F.when(month.isin(12, 1, 2), "DJF").when(month.isin(3, 4, 5), "MAM")
            .when(month.isin(6, 7, 8), "JJA").otherwise("SON"))


def month_start(time: Column) -> Column:
    return F.date_trunc("month", time).cast("timestamp_ntz")


def hour_start(time: Column) -> Column:
    return F.date_trunc("hour", time).cast("timestamp_ntz")


def plus_hours(time: Column, hours: Column) -> Column:
    return time + F.make_dt_interval(hours=hours)


def hourly_axis(month: Column) -> Column:
    """Array of every hour of the month, from day one 00 UTC to the last day 23 UTC."""
    first = month_start(month)
    last = F.last_day(month).cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(23))
    return F.sequence(first, last, F.expr("interval 1 hour"))


def doy_to_date(doy: Column, year: Column) -> Column:
    return F.date_add(F.make_date(year, F.lit(1), F.lit(1)), (doy - 1).cast("int"))


def extract_date(name: Column) -> Column:
    """The first date inside a string: yyyyMMddHH, yyyyMMdd or yyyy-MM-dd, optionally ``_HH`` after it."""
    day = F.regexp_extract(name, r"(\d{4})-?(\d{2})-?(\d{2})", 0)
    hour = F.regexp_extract(name, r"\d{4}-?\d{2}-?\d{2}[T_]?(\d{2})(?!\d)", 1)
    text = F.concat(F.regexp_replace(day, "-", ""), F.when(hour == "", "00").otherwise(hour))
    return F.try_to_timestamp(text, F.lit("yyyyMMddHH")).cast("timestamp_ntz")


def ensure_datetime(value: Column) -> Column:
    """Anything date-like as a timestamp, NULL where it is not."""
    return value.try_cast("timestamp_ntz")


def forecast_run(valid: Column, model: str = "era5", offset: int = 6) -> dict[str, Column]:
    """Start of the run that serves a valid time, and the lead hour in it.

    A run is used from ``offset`` hours after its start; earlier hours come from the run before.
    """
    if offset >= 12:
        raise ValueError(f"offset must be smaller than 12, but is {offset}")
    if model.lower() not in RUN_HOURS:
        raise ValueError(f"unknown model '{model}', known: {', '.join(RUN_HOURS)}")
    first, second = RUN_HOURS[model.lower()]
    hour = F.hour(valid)
    lead = (F.when(hour < offset + first, 24 - second + hour)
            .when(hour < offset + second, hour - first)
            .otherwise(hour - second))
    return {"run_init": plus_hours(hour_start(valid), -lead), "lead": lead}
