"""Scans, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspark.catalog.fixtures import e_rows, table, view_d, view_e, view_f, view_h
from gridspark.catalog.registry import query, r, rd, sts, ts
from gridspark.operators.align import append_purpose
from gridspark.operators.evaluate import score_by_hour, scores_table
from gridspark.operators.normalize import zscore_stats
from gridspark.operators.scores import scores_by
from gridspark.operators.select import natural_order, split_label
from gridspark.plans.verify import verification_table
from gridspark.session import scratch_dir
from gridspark.sources import exchange, griddes, tables

SPLITS = {"train": [(range(1995, 2000), None)], "val": [([2000], None)], "test": [([2001], None)]}
SPLIT_SQL = "CASE WHEN year(time) <= 1999 THEN 'train' WHEN year(time) = 2000 THEN 'val' ELSE 'test' END"


@query("scan_subset", f"""
SELECT {sts()} AS time, iy, ix, {r('t_in')} AS t_in, {r('p_in')} AS p_in, {r('t_tar')} AS t_tar
FROM D WHERE year(time) = 2000""")
def scan_subset(spark, sf_dir):
    base = scratch_dir(spark, "subsets")
    labelled = view_d(spark, sf_dir).withColumn("subset", split_label(F.col("time"), SPLITS))
    tables.write_dataset(labelled, base, "daily")
    rows = tables.scan_subset(spark, base, ["daily"], "daily", "val")
    return rows.select(ts().alias("time"), "iy", "ix", rd("t_in").alias("t_in"), rd("p_in").alias("p_in"),
                       rd("t_tar").alias("t_tar"))


@query("file_natural_order", """
SELECT fname, CAST(regexp_extract(fname, '\\d+') AS BIGINT) AS order_key,
  row_number() OVER (ORDER BY CAST(regexp_extract(fname, '\\d+') AS BIGINT), fname, o_orderkey) AS pos FROM F""")
def file_natural_order(spark, sf_dir):
    return natural_order(view_f(spark, sf_dir).select("fname"))


@query("scan_multifile", f"""
SELECT {sts()} AS time, iy, ix, {r('t_in')} AS t_in FROM D WHERE year(time) IN (1996, 1998)""")
def scan_multifile(spark, sf_dir):
    base = scratch_dir(spark, "monthly")
    tables.write_monthly(view_d(spark, sf_dir), base)
    paths = [f"{base}/year={y}/month=*" for y in (1996, 1998)]
    df = tables.scan_multifile(spark, paths, ["time", "iy", "ix", "t_in"])
    return df.select(ts().alias("time"), "iy", "ix", rd("t_in").alias("t_in"))


@query("append_purpose", f"""
SELECT purpose, count(DISTINCT time) AS samples, count(*) AS n, {r('avg(t_in)')} AS t_in
FROM (SELECT *, {SPLIT_SQL} AS purpose FROM D) GROUP BY purpose""")
def append_purpose_(spark, sf_dir):
    d = view_d(spark, sf_dir)
    year = F.year("time")
    parts = append_purpose(train=d.where(year <= 1999), val=d.where(year == 2000), test=d.where(year >= 2001))
    return parts.groupBy("purpose").agg(F.count_distinct("time").alias("samples"), F.count("*").alias("n"),
                                        rd(F.avg("t_in")).alias("t_in"))


@query("sink_compressed", f"""
SELECT t, count(*) AS n, {r('sum(fcst)')} AS fcst, {r('sum(ref_ * ref_)')} AS ref2 FROM E GROUP BY t""")
def sink_compressed(spark, sf_dir):
    path = scratch_dir(spark, "compressed")
    tables.write_compressed(view_e(spark, sf_dir), path)
    return spark.read.parquet(path).groupBy("t").agg(
        F.count("*").alias("n"), rd(F.sum("fcst")).alias("fcst"), rd(F.sum(F.col("ref_") ** 2)).alias("ref2"))


MONTHLY = f"""
SELECT CAST(year(time) AS INT) AS year, CAST(month(time) AS INT) AS month, count(*) AS n, {r('avg(t_in)')} AS t_in,
  {r('avg(p_in)', 4)} AS p_in FROM D GROUP BY ALL"""


def _monthly(df):
    return df.groupBy("year", "month").agg(F.count("*").alias("n"), rd(F.avg("t_in")).alias("t_in"),
                                           rd(F.avg("p_in"), 4).alias("p_in"))


@query("sink_monthly", MONTHLY)
def sink_monthly(spark, sf_dir):
    path = scratch_dir(spark, "monthly")
    tables.write_monthly(view_d(spark, sf_dir), path)
    return _monthly(spark.read.parquet(path))


@query("incremental_missing", MONTHLY)
def incremental_missing(spark, sf_dir):
    path = scratch_dir(spark, "incremental")
    d = view_d(spark, sf_dir)
    # the last month that is there holds ten days only
    tables.write_monthly(d.where((F.year("time") <= 1998) & ~((F.year("time") == 1998) & (F.dayofyear("time") > 345))), path)
    tables.append_missing(d, path)
    return _monthly(spark.read.parquet(path))


def _hourly(df, name="rmse"):
    return scores_table(score_by_hour(scores_by(df, [name], ["time"]), name), name)


HOURLY_SQL = """SELECT hour(time) AS hour, avg(s) AS m, stddev_pop(s) AS d
  FROM (SELECT time, sqrt(avg(power({f} - ref_, 2))) AS s FROM H GROUP BY time) GROUP BY 1"""


@query("scores_table", f"""
SELECT hour, {r('m')} AS rmse_mean, {r('d')} AS rmse_std FROM ({HOURLY_SQL.format(f='fcst')})""")
def scores_table_(spark, sf_dir):
    path = scratch_dir(spark, "scores") + "/eval_idbase_rmse"
    exchange.write_scores(_hourly(view_h(spark, sf_dir)), path)
    return exchange.read_scores(spark, [path], "rmse").select(
        "hour", rd("rmse_mean").alias("rmse_mean"), rd("rmse_std").alias("rmse_std"))


@query("scores_read", f"""
SELECT 'base' AS exp, hour, {r('m')} AS rmse_mean, {r('d')} AS rmse_std FROM ({HOURLY_SQL.format(f='fcst')})
UNION ALL
SELECT 'half', hour, {r('m')}, {r('d')} FROM ({HOURLY_SQL.format(f='fcst * 0.5')})""")
def scores_read(spark, sf_dir):
    base = scratch_dir(spark, "scores")
    h = view_h(spark, sf_dir)
    runs = {"base": h, "half": h.withColumn("fcst", F.col("fcst") * 0.5)}
    paths = [f"{base}/eval_id{name}_rmse" for name in runs]
    for path, df in zip(paths, runs.values()):
        exchange.write_scores(_hourly(df), path)
    return exchange.read_scores(spark, paths, "rmse").select(
        "exp", "hour", rd("rmse_mean").alias("rmse_mean"), rd("rmse_std").alias("rmse_std"))


@query("norm_json_roundtrip", " UNION ALL ".join(
    f"SELECT '{v}' AS variable, {r(f'avg({v})', 4)} AS mu, {r(f'stddev_pop({v})', 4)} AS sigma FROM D"
    for v in ("t_in", "p_in", "t_tar")))
def norm_json_roundtrip(spark, sf_dir):
    path = scratch_dir(spark, "stats")
    exchange.write_stats(zscore_stats(view_d(spark, sf_dir), ["t_in", "p_in", "t_tar"]), path)
    return exchange.read_stats(spark, path).select("variable", rd("mu", 4).alias("mu"), rd("sigma", 4).alias("sigma"))


@query("norm_json_per_cell", " UNION ALL ".join(
    f"SELECT iy, ix, '{v}' AS variable, {r(f'avg({v})', 4)} AS mu, {r(f'stddev_pop({v})', 4)} AS sigma FROM D GROUP BY iy, ix"
    for v in ("t_in", "t_tar")))
def norm_json_per_cell(spark, sf_dir):
    path = scratch_dir(spark, "stats")
    exchange.write_stats(zscore_stats(view_d(spark, sf_dir), ["t_in", "t_tar"], ["iy", "ix"]), path)
    return exchange.read_stats(spark, path, keys="iy int, ix int").select(
        "iy", "ix", "variable", rd("mu", 4).alias("mu"), rd("sigma", 4).alias("sigma"))


@query("griddes_parse", """
WITH lines AS (
  SELECT p_partkey, unnest(string_split(concat('# a comment', chr(10), 'gridtype = lonlat', chr(10), 'xsize = ',
    p_size, chr(10), ' ysize=', p_partkey % 50 + 1, ' ', chr(10), 'xfirst = -', p_size, chr(10), 'xinc = 0.0625',
    chr(10), 'yfirst = ', p_size % 7, chr(10), 'yinc = -0.5', chr(10), 'a = b = c',
    CASE WHEN p_size % 5 = 0 THEN chr(10) || 'colour = blue' ELSE '' END), chr(10))) AS line FROM part),
entries AS (SELECT p_partkey, trim(split_part(line, '=', 1)) AS k, trim(split_part(line, '=', 2)) AS v
  FROM lines WHERE len(string_split(line, '=')) = 2)
SELECT p_partkey, max(v) FILTER (WHERE k = 'gridtype') AS gridtype,
  CAST(max(v) FILTER (WHERE k = 'xsize') AS INT) AS xsize, CAST(max(v) FILTER (WHERE k = 'ysize') AS INT) AS ysize,
  CAST(max(v) FILTER (WHERE k = 'xfirst') AS DOUBLE) AS xfirst, CAST(max(v) FILTER (WHERE k = 'xinc') AS DOUBLE) AS xinc,
  CAST(max(v) FILTER (WHERE k = 'yfirst') AS DOUBLE) AS yfirst, CAST(max(v) FILTER (WHERE k = 'yinc') AS DOUBLE) AS yinc,
  coalesce(max(k) FILTER (WHERE k = 'colour'), '') AS invalid_keys
FROM entries GROUP BY p_partkey""")
def griddes_parse(spark, sf_dir):
    size, key = F.col("p_size").cast("string"), F.col("p_partkey")
    text = F.concat_ws(
        "\n", F.lit("# a comment"), F.lit("gridtype = lonlat"), F.concat(F.lit("xsize = "), size),
        F.concat(F.lit(" ysize="), (key % 50 + 1).cast("string"), F.lit(" ")), F.concat(F.lit("xfirst = -"), size),
        F.lit("xinc = 0.0625"), F.concat(F.lit("yfirst = "), (F.col("p_size") % 7).cast("string")),
        F.lit("yinc = -0.5"), F.lit("a = b = c"), F.when(F.col("p_size") % 5 == 0, "colour = blue"))
    lines = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.split(text, "\n")).alias("value"))
    return griddes.parse_grids(lines, keys=["p_partkey"], strict=False).withColumn(
        "invalid_keys", F.array_join("invalid_keys", ","))


@query("verification_table", f"""
SELECT t, iy, ix, {r('fcst')} AS fcst, {r('ref_')} AS ref_ FROM E""")
def verification_table_(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings")
    fcst = e_rows(emb.select((F.col("vec_id") - 1).alias("t"), "embedding"), "embedding")
    ref = e_rows(emb.select(F.col("vec_id").alias("t"), "embedding"), "embedding")
    stored = verification_table(fcst, ref, scratch_dir(spark, "verification"), time="t")
    return stored.select("t", "iy", "ix", rd("fcst").alias("fcst"), rd("ref_").alias("ref_"))
