"""Filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspark.catalog.fixtures import events, view_d, view_e, view_f, view_h, view_l
from gridspark.catalog.q_reshape import STIME, _out
from gridspark.catalog.registry import query, r, rd, sts, ts
from gridspark.functions.calendar import forecast_run
from gridspark.operators import select
from gridspark.operators.grid import Grid

BOX_GRID = Grid(4, 3, 7.0, 0.5, 50.0, -0.5)


@query("sel_lonlat_box", f"""
SELECT t, iy, ix, {r('fcst')} AS fcst FROM E WHERE lon BETWEEN 7.0 AND 8.75 AND lat BETWEEN 48.75 AND 50.0""")
def sel_lonlat_box(spark, sf_dir):
    df = select.sel_lonlat_box(view_e(spark, sf_dir), BOX_GRID.box())
    return df.select("t", "iy", "ix", rd("fcst").alias("fcst"))


@query("sel_lonlat_box_wrap", f"""
SELECT t, iy, ix, {r('fcst')} AS fcst FROM E WHERE ((ix * 45) % 360 >= 300 OR (ix * 45) % 360 <= 50) AND lat BETWEEN 48.75 AND 50.0""")
def sel_lonlat_box_wrap(spark, sf_dir):
    # a table of 0..360 degrees and a box across its first meridian
    around = view_e(spark, sf_dir).withColumn("lon", 45.0 * F.col("ix"))
    return select.sel_lonlat_box(around, (-60.0, 50.0, 48.75, 50.0)).select("t", "iy", "ix", rd("fcst").alias("fcst"))


@query("sel_hours", f"SELECT {STIME}, {r('ref_')} AS ref_ FROM H WHERE hour(time) BETWEEN 10 AND 16")
def sel_hours(spark, sf_dir):
    return _out(select.sel_hours(view_h(spark, sf_dir), range(10, 17)), "ref_")


@query("sel_season", f"""
SELECT 'MAM' AS season, {STIME}, {r('t_in')} AS t_in FROM D WHERE month(time) IN (3, 4, 5)
UNION ALL SELECT 'winter', {STIME}, {r('t_in')} FROM D WHERE month(time) IN (1, 2, 3, 10, 11, 12)""")
def sel_season(spark, sf_dir):
    d = view_d(spark, sf_dir)
    spring, winter = select.sel_season(d, "MMA"), select.sel_season(d, "winter")
    return _named(spring, "MAM").unionByName(_named(winter, "winter"))


def _named(df, name):
    return df.select(F.lit(name).alias("season"), ts().alias("time"), "iy", "ix", rd("t_in").alias("t_in"))


@query("split_year_month", f"""
SELECT {STIME}, CASE WHEN year(time) <= 1999 THEN 'train' WHEN year(time) = 2000 AND month(time) <= 6 THEN 'val'
  ELSE 'test' END AS split FROM D""")
def split_year_month(spark, sf_dir):
    splits = {"train": [(range(1995, 2000), None)], "val": [([2000], range(1, 7))],
              "test": [([2000], range(7, 13)), ([2001], None)]}
    return view_d(spark, sf_dir).select(ts().alias("time"), "iy", "ix",
                                        select.split_label(F.col("time"), splits).alias("split"))


@query("sel_level", f"SELECT {STIME}, level, {r('t')} AS t FROM L WHERE level IN (50000, 85000)")
def sel_level(spark, sf_dir):
    df = select.sel_level(view_l(spark, sf_dir), [50000, 85000])
    return df.select(ts().alias("time"), "iy", "ix", "level", rd("t").alias("t"))


LEAD_SQL = """CASE WHEN hour(time) < 12 THEN 6 + hour(time) WHEN hour(time) < 24 THEN hour(time) - 6
  ELSE hour(time) - 18 END"""


@query("sel_leadtime", f"""
SELECT * FROM (SELECT {STIME}, {LEAD_SQL} AS lead, {r('fcst')} AS fcst FROM H) WHERE lead BETWEEN 0 AND 11""")
def sel_leadtime(spark, sf_dir):
    df = view_h(spark, sf_dir).withColumns(forecast_run(F.col("time"), "era5", 6))
    df = select.sel_leadtime(df)
    return df.select(ts().alias("time"), "iy", "ix", "lead", rd("fcst").alias("fcst"))


@query("cap_samples", f"""
SELECT {STIME}, {r('t_in')} AS t_in FROM D
WHERE time IN (SELECT DISTINCT time FROM D ORDER BY time LIMIT 500)""")
def cap_samples(spark, sf_dir):
    return _out(select.cap_samples(view_d(spark, sf_dir), 500), "t_in")


@query("drop_missing_zero", f"""
SELECT {sts("date_trunc('hour', ts)")} AS time, event_type, value AS ref_ FROM events
WHERE value > 0 AND value IS NOT NULL AND value < 400""")
def drop_missing_zero(spark, sf_dir):
    # values from 400 on stand for missing ones
    df = events(spark, sf_dir).withColumn("ref_", F.when(F.col("ref_") < 400, F.col("ref_")))
    return select.drop_missing_zero(df, "ref_").select(ts().alias("time"), "event_type", "ref_")


@query("complete_times", f"""
SELECT {STIME}, {r('ref_')} AS ref_ FROM H
WHERE time IN (SELECT time FROM H GROUP BY time HAVING count(*) = 12)""")
def complete_times(spark, sf_dir):
    return _out(select.complete_times(view_h(spark, sf_dir), ["iy", "ix"], 12), "ref_")


@query("start_cutoff", f"SELECT {STIME}, {r('t_in')} AS t_in FROM D WHERE time > TIMESTAMP '1999-06-30 00:00:00'")
def start_cutoff(spark, sf_dir):
    return _out(select.start_cutoff(view_d(spark, sf_dir), "1999-06-30 00:00:00"), "t_in")


@query("subset_files_on_date", "SELECT o_orderkey, fname FROM F WHERE substr(fname, 14, 2) = '04'")
def subset_files_on_date(spark, sf_dir):
    return select.subset_files_on_date(view_f(spark, sf_dir), 4).select("o_orderkey", "fname")


@query("sel_matching_coords", f"""
SELECT t, iy, ix, {r('fcst')} AS fcst FROM E WHERE (iy, ix) IN (SELECT (iy, ix) FROM Z)""")
def sel_matching_coords(spark, sf_dir):
    from gridspark.catalog.fixtures import view_z

    df = select.sel_matching_coords(view_e(spark, sf_dir), view_z(spark, sf_dir))
    return df.select("t", "iy", "ix", rd("fcst").alias("fcst"))
