"""Scalar functions, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspark import columns
from gridspark.catalog.fixtures import events, table, view_d, view_f, view_h
from gridspark.catalog.q_reshape import STIME, _out
from gridspark.catalog.q_scores import SEASON
from gridspark.catalog.registry import query, r, sts, ts
from gridspark.functions import calendar, names
from gridspark.operators import align, select


@query("sort_time", f"SELECT {sts()} AS time, row_number() OVER (ORDER BY D.time) AS pos FROM (SELECT DISTINCT time FROM D) D")
def sort_time(spark, sf_dir):
    df = align.sort_time(view_d(spark, sf_dir).select("time").distinct())
    return df.select(ts().alias("time"), "pos")


@query("merge_time_union", f"SELECT {STIME}, {r('t_in')} AS t_in FROM D")
def merge_time_union(spark, sf_dir):
    d = view_d(spark, sf_dir).select("time", "iy", "ix", "t_in")
    odd = F.month("time") % 2 == 1
    return _out(align.merge_time_union(d.where(odd), d.where(~odd)), "t_in")


@query("time_intersection", f"""
SELECT {sts('x.time')} AS time FROM (SELECT time FROM D INTERSECT SELECT o_orderdate FROM orders) x""")
def time_intersection(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("time"))
    return align.time_intersection(view_d(spark, sf_dir), orders).select(ts().alias("time"))


@query("missing_names", """
WITH H1 AS (SELECT date_trunc('hour', ts) AS time, event_type FROM events)
SELECT strftime(t.time, '%Y-%m-%d %H:%M:%S') AS time, n.event_type FROM (SELECT DISTINCT time FROM H1) t,
  (SELECT DISTINCT event_type FROM H1) n WHERE NOT EXISTS (
  SELECT 1 FROM H1 h WHERE h.time = t.time AND h.event_type = n.event_type)""")
def missing_names(spark, sf_dir):
    lost = columns.missing_per_key(events(spark, sf_dir), ["time"], "event_type")
    return lost.select(ts().alias("time"), "event_type")


@query("first_sample", f"SELECT {STIME}, {r('fcst')} AS fcst FROM H WHERE time = (SELECT min(time) FROM H)")
def first_sample(spark, sf_dir):
    return _out(select.first_sample(view_h(spark, sf_dir)), "fcst")


@query("season_of", f"SELECT {SEASON} AS season, count(*) AS n, count(DISTINCT time) AS steps FROM D GROUP BY 1")
def season_of(spark, sf_dir):
    d = view_d(spark, sf_dir).withColumn("season", calendar.season_of(F.col("time")))
    return d.groupBy("season").agg(F.count("*").alias("n"), F.count_distinct("time").alias("steps"))


@query("hour_of", """
SELECT event_id, hour(ts) AS hour, month(ts) AS month, year(ts) AS year FROM events""")
def hour_of(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.hour("ts").alias("hour"), F.month("ts").alias("month"),
                                                 F.year("ts").alias("year"))


@query("last_day_of_month", "SELECT o_orderkey, strftime(last_day(o_orderdate), '%Y-%m-%d') AS last_day FROM F")
def last_day_of_month(spark, sf_dir):
    return view_f(spark, sf_dir).select("o_orderkey", F.last_day("o_orderdate").cast("string").alias("last_day"))


@query("doy_to_month", """
SELECT o_orderkey, dayofyear(o_orderdate) AS doy, strftime(o_orderdate, '%Y-%m-%d') AS day FROM F""")
def doy_to_month(spark, sf_dir):
    doy, year = F.dayofyear("o_orderdate"), F.year("o_orderdate")
    return view_f(spark, sf_dir).select("o_orderkey", doy.alias("doy"),
                                        calendar.doy_to_date(doy, year).cast("string").alias("day"))


@query("hourly_axis", f"""
SELECT {sts('unnest(generate_series(m, m + INTERVAL 1 MONTH - INTERVAL 1 HOUR, INTERVAL 1 HOUR))')} AS time
FROM (SELECT DISTINCT date_trunc('month', o_orderdate) AS m FROM orders)""")
def hourly_axis(spark, sf_dir):
    months = table(spark, sf_dir, "orders").select(calendar.month_start(F.col("o_orderdate")).alias("m")).distinct()
    hours = months.select(F.explode(calendar.hourly_axis(F.col("m"))).alias("time"))
    return hours.select(ts().alias("time"))


@query("year_month_axis", """
SELECT y AS year, CAST(m AS INT) AS month, strftime(make_date(y, m, 1), '%Y-%m') AS label
FROM (SELECT DISTINCT year(o_orderdate) AS y FROM orders), range(1, 13) x(m)""")
def year_month_axis(spark, sf_dir):
    years = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year")).distinct()
    axis = years.withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))
    return axis.withColumn("label", F.date_format(F.make_date("year", "month", F.lit(1)), "yyyy-MM"))



@query("extract_date", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || CASE WHEN o_orderkey % 2 = 0
  THEN ' ' || lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') || ':00:00' ELSE ' 00:00:00' END AS date FROM F""")
def extract_date(spark, sf_dir):
    dashed = F.concat(F.lit("run "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" final.nc"))
    name = F.when(F.col("o_orderkey") % 2 == 0, F.col("fname")).otherwise(dashed)
    dated = view_f(spark, sf_dir).withColumn("date", calendar.extract_date(name))
    return dated.select("o_orderkey", ts("date").alias("date"))


@query("ensure_datetime", """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN 'none' WHEN o_orderkey % 3 = 1
  THEN strftime(o_orderdate, '%Y-%m-%d') || ' 06:30:00' ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS date FROM orders""")
def ensure_datetime(spark, sf_dir):
    day, kind = F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderkey") % 3
    text = F.when(kind == 0, day).when(kind == 1, F.concat(day, F.lit("T06:30:00"))).otherwise("not a date")
    df = table(spark, sf_dir, "orders").withColumn("date", calendar.ensure_datetime(text))
    return df.select("o_orderkey", F.coalesce(ts("date"), F.lit("none")).alias("date"))


@query("exp_id_from_name", """
SELECT o_orderkey, regexp_extract('scores/eval_id' || o_orderkey % 97 || 'x_rmse.csv', 'id([^_]*)_', 1) AS exp_id FROM orders""")
def exp_id_from_name(spark, sf_dir):
    path = F.concat(F.lit("scores/eval_id"), (F.col("o_orderkey") % 97).cast("string"), F.lit("x_rmse.csv"))
    return table(spark, sf_dir, "orders").select("o_orderkey", names.experiment_id(path).alias("exp_id"))


@query("shape_from_name", """
SELECT o_orderkey, 3 AS dims, CAST(o_orderkey % 7 + 1 AS INT) AS first, CAST(o_orderkey % 11 + 2 AS INT) AS last FROM orders""")
def shape_from_name(spark, sf_dir):
    k = F.col("o_orderkey")
    ending = F.when(k % 2 == 0, "_phys.dat").otherwise(".dat")
    path = F.concat(F.lit("pred_s_"), (k % 7 + 1).cast("string"), F.lit("_8_"), (k % 11 + 2).cast("string"), ending)
    shape = names.shape_of(path)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.size(shape).alias("dims"), shape[0].alias("first"),
                                                 shape[2].alias("last"))


@query("pressure_levels", """
SELECT p_partkey, CAST(1 + CAST(p_size * 1000 <> 85000 AS INT) AS BIGINT) AS n, CAST(least(85000, p_size * 1000) AS INT) AS lowest,
  CAST(85000 + p_size * 1000 AS BIGINT) AS total FROM part""")
def pressure_levels(spark, sf_dir):
    # {"t": ["p85000", "p<size>000"], "q": ["p85000"]} per part
    own = F.concat(F.lit("p"), (F.col("p_size") * 1000).cast("string"))
    ids = F.flatten(F.map_values(F.create_map(F.lit("t"), F.array(F.lit("p85000"), own),
                                              F.lit("q"), F.array(F.lit("p85000")))))
    df = table(spark, sf_dir, "part").select("p_partkey", names.pressure_levels(ids).alias("lv"))
    total = F.aggregate("lv", F.lit(0).cast("bigint"), lambda s, x: s + x)
    return df.select("p_partkey", F.size("lv").cast("bigint").alias("n"), F.get("lv", F.lit(0)).alias("lowest"),
                     total.alias("total"))


@query("parse_predictors", """
SELECT p_partkey, 'sf' AS vartype, '2t' AS variable, 'none' AS level FROM part
UNION ALL SELECT p_partkey, 'ml', 't', 'p' || p_size * 1000 FROM part UNION ALL SELECT p_partkey, 'ml', 't', 'p92500' FROM part
UNION ALL SELECT p_partkey, 'fc_pl', lower(left(p_type, 1)), 'p70000' FROM part""")
def parse_predictors(spark, sf_dir):
    text = F.concat(F.lit('{"sf": {"2t": null}, "ml": {"t": ["p'), (F.col("p_size") * 1000).cast("string"),
                    F.lit('", "p92500"]}, "fc_pl": {"'), F.lower(F.substring("p_type", 1, 1)), F.lit('": ["p70000"]}}'))
    parts = table(spark, sf_dir, "part").select("p_partkey", text.alias("text"))
    rows = names.predictor_rows(parts, "text", ["p_partkey"])
    return rows.select("p_partkey", "vartype", "variable", F.coalesce("level", F.lit("none")).alias("level"))


@query("forecast_run_ifs", f"""
SELECT event_id, {sts('''date_trunc('day', ts) + CASE WHEN hour(ts) < 3 THEN -INTERVAL 12 HOUR
  WHEN hour(ts) < 15 THEN INTERVAL 0 HOUR ELSE INTERVAL 12 HOUR END''')} AS run_init,
  CAST(CASE WHEN hour(ts) < 3 THEN 12 + hour(ts) WHEN hour(ts) < 15 THEN hour(ts) ELSE hour(ts) - 12 END AS INT) AS lead
FROM events""")
def forecast_run_ifs(spark, sf_dir):
    run = calendar.forecast_run(F.col("ts"), "ifs", 3)
    return table(spark, sf_dir, "events").withColumns(run).select("event_id", ts("run_init").alias("run_init"), "lead")
