"""Block bootstrap, permutation, importance and models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from gridspark.catalog.fixtures import view_d, view_e
from gridspark.catalog.registry import hash_sql, query, r, rd
from gridspark.operators import model, resample, reshape
from gridspark.operators.scores import rmse
from gridspark.session import stored

BLOCKS = f"""SELECT CAST(floor((rn - 1) / 10) AS BIGINT) AS iblock, avg(rmse) AS rmse, avg(bias) AS bias FROM (
    SELECT row_number() OVER (ORDER BY time) AS rn, rmse, bias FROM (
      SELECT time, sqrt(avg(power(t_in - t_tar, 2))) AS rmse, avg(t_in - t_tar) AS bias FROM D GROUP BY time))
  GROUP BY 1 HAVING count(*) = 10"""
NBOOTS = 1000
BOOTS = f"""WITH B AS ({BLOCKS}), N AS (SELECT count(*) AS n FROM B),
DR AS (SELECT b AS iboot, s AS slot, CAST(floor(CAST({hash_sql("'42'", 'b', 's')} AS DOUBLE) / 4294967296 * n) AS BIGINT) AS iblock
  FROM range({NBOOTS}) x(b), N, range(100000) y(s) WHERE s < n),
BS AS (SELECT iboot, avg(rmse) AS rmse, avg(bias) AS bias FROM DR JOIN B USING (iblock) GROUP BY iboot)"""


def _blocks(spark, sf_dir):
    per_time = view_d(spark, sf_dir).groupBy("time").agg(
        rmse("t_in", "t_tar").alias("rmse"), F.avg(F.col("t_in") - F.col("t_tar")).alias("bias"))
    return resample.block_means(per_time, ["rmse", "bias"], 10)


@query("block_means", f"WITH B AS ({BLOCKS}) SELECT iblock, {r('rmse')} AS rmse, {r('bias')} AS bias FROM B")
def block_means(spark, sf_dir):
    return _blocks(spark, sf_dir).select("iblock", rd("rmse").alias("rmse"), rd("bias").alias("bias"))


@query("block_bootstrap", f"{BOOTS} SELECT iboot, {r('rmse')} AS rmse_bootstrapped, {r('bias')} AS bias_bootstrapped FROM BS")
def block_bootstrap(spark, sf_dir):
    df = resample.block_bootstrap(_blocks(spark, sf_dir), ["rmse", "bias"], NBOOTS)
    return df.select("iboot", *[rd(c).alias(c) for c in ("rmse_bootstrapped", "bias_bootstrapped")])


@query("block_bootstrap_cells", f"""
WITH R AS (SELECT time, floor((row_number() OVER (ORDER BY time) - 1) / 10) AS iblock FROM (SELECT DISTINCT time FROM D)),
W AS (SELECT iblock FROM R GROUP BY 1 HAVING count(*) = 10),
B AS (SELECT iy, ix, iblock, avg(abs(t_in - t_tar)) AS mae FROM D JOIN R USING (time) JOIN W USING (iblock) GROUP BY ALL),
N AS (SELECT count(*) AS n FROM W),
DR AS (SELECT b AS iboot, CAST(floor(CAST({hash_sql("'42'", 'b', 's')} AS DOUBLE) / 4294967296 * n) AS BIGINT) AS iblock
  FROM range(20) x(b), N, range(100000) y(s) WHERE s < n)
SELECT iy, ix, iboot, {r('avg(mae)')} AS mae_bootstrapped FROM DR JOIN B USING (iblock) GROUP BY ALL""")
def block_bootstrap_cells(spark, sf_dir):
    d = view_d(spark, sf_dir).withColumn("mae", F.abs(F.col("t_in") - F.col("t_tar")))
    blocks = resample.block_means(d, ["mae"], 10, keys=["iy", "ix"])
    boots = resample.block_bootstrap(blocks, ["mae"], 20, keys=["iy", "ix"])
    return boots.select("iy", "ix", "iboot", rd("mae_bootstrapped").alias("mae_bootstrapped"))


@query("bootstrap_ci_cells", f"""
WITH R AS (SELECT time, floor((row_number() OVER (ORDER BY time) - 1) / 10) AS iblock FROM (SELECT DISTINCT time FROM D)),
W AS (SELECT iblock FROM R GROUP BY 1 HAVING count(*) = 10),
B AS (SELECT iy, ix, iblock, avg(abs(t_in - t_tar)) AS mae, avg(t_in - t_tar) AS bias FROM D JOIN R USING (time) JOIN W USING (iblock) GROUP BY ALL),
N AS (SELECT count(*) AS n FROM W),
DR AS (SELECT b AS iboot, CAST(floor(CAST({hash_sql("'42'", 'b', 's')} AS DOUBLE) / 4294967296 * n) AS BIGINT) AS iblock
  FROM range({NBOOTS}) x(b), N, range(100000) y(s) WHERE s < n),
BS AS (SELECT iy, ix, iboot, avg(mae) AS mae, avg(bias) AS bias FROM DR JOIN B USING (iblock) GROUP BY ALL)
SELECT iy, ix, {r('quantile_cont(mae, 0.025)')} AS mae_lower, {r('quantile_cont(mae, 0.975)')} AS mae_upper,
  {r('quantile_cont(bias, 0.025)')} AS bias_lower, {r('quantile_cont(bias, 0.975)')} AS bias_upper FROM BS GROUP BY iy, ix""")
def bootstrap_ci_cells(spark, sf_dir):
    bias = F.col("t_in") - F.col("t_tar")
    d = view_d(spark, sf_dir).withColumns({"mae": F.abs(bias), "bias": bias})
    blocks = resample.block_means(d, ["mae", "bias"], 10, keys=["iy", "ix"])
    df = resample.block_bootstrap_ci(blocks, ["mae", "bias"], {"lower": 0.025, "upper": 0.975}, NBOOTS, keys=["iy", "ix"])
    return df.select("iy", "ix", *[rd(c).alias(c) for c in ("mae_lower", "mae_upper", "bias_lower", "bias_upper")])


@query("bootstrap_ci", f"""{BOOTS} SELECT {r('quantile_cont(rmse, 0.025)')} AS lower, {r('quantile_cont(rmse, 0.5)')} AS median,
  {r('quantile_cont(rmse, 0.975)')} AS upper FROM BS""")
def bootstrap_ci(spark, sf_dir):
    boots = resample.block_bootstrap(_blocks(spark, sf_dir), ["rmse"], NBOOTS)
    df = resample.bootstrap_ci(boots, "rmse_bootstrapped", {"lower": 0.025, "median": 0.5, "upper": 0.975})
    return df.select(*[rd(c).alias(c) for c in ("lower", "median", "upper")])


def time_moves(*salt: str, keys: str = "") -> str:
    """Moves of time steps: rank by hash to rank by time."""
    part = f"PARTITION BY {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    source = f"(SELECT DISTINCT {lead}t FROM EX)" if keys else "(SELECT DISTINCT t FROM E)"
    join = f"a.rn = b.rn AND a.{keys} = b.{keys}" if keys else "a.rn = b.rn"
    return f"""SELECT a.* EXCLUDE (rn), b.t AS t_to FROM (
      SELECT {lead}t, row_number() OVER ({part} ORDER BY {hash_sql(*salt, 't')}, t) AS rn FROM {source}) a
    JOIN (SELECT {lead}t, row_number() OVER ({part} ORDER BY t) AS rn FROM {source}) b ON {join}"""


def patch_moves(*salt: str, keys: str = "", ph: int = 2, pw: int = 4) -> str:
    """Moves of patches on the 8x8 grid."""
    n, cols = (8 // ph) * (8 // pw), 8 // pw
    part = f"PARTITION BY {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    source = f"range({n}) x(pid)" + (", (SELECT unnest(['fcst', 'sq']) AS predictor)" if keys else "")
    return f"""SELECT {lead}pid // {cols} AS py, pid % {cols} AS px, (rn - 1) // {cols} AS py_to, (rn - 1) % {cols} AS px_to
    FROM (SELECT {lead}pid, row_number() OVER ({part} ORDER BY {hash_sql(*salt, 'pid')}, pid) AS rn FROM {source})"""


@query("permute_time", f"""WITH M AS ({time_moves("'7'")})
SELECT M.t_to AS t, e.iy, e.ix, {r('e.fcst')} AS fcst FROM E e JOIN M ON M.t = e.t""")
def permute_time(spark, sf_dir):
    df = resample.permute_time(view_e(spark, sf_dir).select("t", "iy", "ix", "fcst"), 7, "t")
    return df.select("t", "iy", "ix", rd("fcst").alias("fcst"))


MOVED = "CAST(py_to * 2 + iy % 2 AS INT) AS iy, CAST(px_to * 4 + ix % 4 AS INT) AS ix"


@query("permute_patches", f"""WITH P AS ({patch_moves("'patch7'")})
SELECT t, {MOVED}, {r('fcst')} AS fcst FROM E e JOIN P ON py = iy // 2 AND px = ix // 4""")
def permute_patches(spark, sf_dir):
    df = resample.permute_patches(view_e(spark, sf_dir).select("t", "iy", "ix", "fcst"), 8, 8, (2, 4), 7)
    return df.select("t", "iy", "ix", rd("fcst").alias("fcst"))


@query("sample_permut_xyt", f"""WITH M AS ({time_moves("'7'")}), P AS ({patch_moves("'patch7'")})
SELECT t_to AS t, {MOVED}, {r('fcst')} AS fcst FROM E e JOIN M ON M.t = e.t JOIN P ON py = iy // 2 AND px = ix // 4""")
def sample_permut_xyt(spark, sf_dir):
    df = resample.sample_permut_xyt(view_e(spark, sf_dir).select("t", "iy", "ix", "fcst"), 8, 8, (2, 4), 7, "t")
    return df.select("t", "iy", "ix", rd("fcst").alias("fcst"))


IMPORTANCE = f"""WITH EX AS (SELECT t, iy, ix, ref_, fcst, fcst * fcst AS sq, predictor
  FROM E e, (SELECT unnest(['fcst', 'sq']) AS predictor)),
M AS ({time_moves("'7'", 'predictor', keys='predictor')}),
P AS ({patch_moves("'patch7'", 'predictor', keys='predictor')}),
V AS (SELECT x.predictor, t_to AS t, {MOVED}, CASE WHEN x.predictor = 'fcst' THEN fcst ELSE sq END AS value FROM EX x
  JOIN M ON M.predictor = x.predictor AND M.t = x.t JOIN P ON P.predictor = x.predictor AND py = iy // 2 AND px = ix // 4),
S AS (SELECT x.predictor, x.t, sqrt(avg(power(0.7 * CASE WHEN x.predictor = 'fcst' THEN v.value ELSE x.fcst END
    + 0.4 * CASE WHEN x.predictor = 'sq' THEN v.value ELSE x.sq END - x.ref_, 2))) AS score
  FROM EX x JOIN V v ON v.predictor = x.predictor AND v.t = x.t AND v.iy = x.iy AND v.ix = x.ix GROUP BY ALL)"""


def _importance(spark, sf_dir):
    e = view_e(spark, sf_dir).select("t", "iy", "ix", "ref_", "fcst", (F.col("fcst") * F.col("fcst")).alias("sq"))
    predict = model.linear_prediction({"fcst": 0.7, "sq": 0.4, "intercept": 0.0})
    return e, predict, model.feature_importance(e, ["fcst", "sq"], "ref_", 8, 8, predict, patch=(2, 4), seed=7, time="t")


@query("feature_importance", f"{IMPORTANCE} SELECT predictor, t, {r('score')} AS score FROM S")
def feature_importance(spark, sf_dir):
    return _importance(spark, sf_dir)[2].select("predictor", "t", rd("score").alias("score"))


@query("feature_importance_psnr", f"""{IMPORTANCE}
SELECT predictor, t, CASE WHEN score = 0 THEN 100.0 ELSE {r('20 * log10(2.5 / score)')} END AS score FROM S""")
def feature_importance_psnr(spark, sf_dir):
    e, predict, _ = _importance(spark, sf_dir)
    df = model.feature_importance(e, ["fcst", "sq"], "ref_", 8, 8, predict, "psnr", (2, 4), 7, "t", pixel_max=2.5)
    return df.select("predictor", "t", rd("score").alias("score"))


def mean_filter(fields):
    """Means over 3x3 cells, edges repeated, of the first channel."""
    f = np.pad(fields[..., 0].astype(np.float64), ((0, 0), (1, 1), (1, 1)), mode="edge")
    return sum(f[:, j:j + 8, i:i + 8] for j in range(3) for i in range(3)) / 9


@query("field_inference", f"""
WITH W AS (SELECT a.t, a.iy, a.ix, avg(CAST(CAST(b.fcst AS FLOAT) AS DOUBLE)) AS m FROM E a,
    (SELECT unnest([-1, 0, 1]) AS dy) y, (SELECT unnest([-1, 0, 1]) AS dx) x
  JOIN E b ON b.t = a.t AND b.iy = greatest(0, least(7, a.iy + dy)) AND b.ix = greatest(0, least(7, a.ix + dx)) GROUP BY ALL)
SELECT W.t, W.iy, W.ix, E.lat, E.lon, {r('2.0 * m + 280.0')} AS fcst FROM W JOIN E ON E.t = W.t AND E.iy = W.iy AND E.ix = W.ix""")
def field_inference(spark, sf_dir):
    e = view_e(spark, sf_dir)
    tensors = reshape.field_tensor(e, ["fcst"], ["ref_"], 8, 8, time="t")
    df = model.field_inference(tensors, mean_filter, 8, 8, ["t"], mu=280.0, sigma=2.0)
    placed = df.join(stored(e.select("iy", "ix", "lat", "lon").distinct(), "cells"), ["iy", "ix"])
    return placed.select("t", "iy", "ix", "lat", "lon", rd("fcst").alias("fcst"))


@query("importance_relative", f"""{IMPORTANCE},
RS AS (SELECT sqrt(avg(power(0.7 * fcst + 0.4 * fcst * fcst - ref_, 2))) AS s FROM E)
SELECT predictor, t, {r('score / s')} AS rel_change, (SELECT ceil(max(score) / max(s) + 1) FROM S, RS)::BIGINT AS axis_max
FROM S, RS""")
def importance_relative(spark, sf_dir):
    e, predict, scores = _importance(spark, sf_dir)
    reference = e.withColumn("p", predict).agg(rmse("p", "ref_").alias("s")).scalar()
    relative = model.importance_relative(scores, reference)
    top = model.importance_axis_max(relative).scalar()
    return relative.select("predictor", "t", rd("rel_change").alias("rel_change"), top.alias("axis_max"))


@query("batch_inference", f"SELECT t, iy, ix, {r('(0.5 * fcst + 0.1) * 2 + 1')} AS pred FROM E")
def batch_inference(spark, sf_dir):
    df = model.batch_inference(view_e(spark, sf_dir), lambda x: 0.5 * x["fcst"] + 0.1, ["fcst"], ["t", "iy", "ix"],
                               mu=1.0, sigma=2.0, out="pred")
    return df.select("t", "iy", "ix", rd("pred").alias("pred"))


@query("linear_downscale", f"""
WITH C AS (SELECT regr_slope(t_tar, t_in) AS a, regr_intercept(t_tar, t_in) AS b FROM D)
SELECT iy, ix, {r('avg(a * t_in + b)')} AS mean_fcst, {r('sqrt(avg(power(a * t_in + b - t_tar, 2)))')} AS rmse FROM D, C
GROUP BY iy, ix""")
def linear_downscale(spark, sf_dir):
    d = view_d(spark, sf_dir)
    fitted = model.linear_prediction(model.fit_linear(d, ["t_in"], "t_tar"))
    df = d.withColumn("fcst", fitted).groupBy("iy", "ix").agg(
        F.avg("fcst").alias("mean_fcst"), rmse("fcst", "t_tar").alias("rmse"))
    return df.select("iy", "ix", rd("mean_fcst").alias("mean_fcst"), rd("rmse").alias("rmse"))
