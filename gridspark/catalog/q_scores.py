"""Normalisation, error scores, contingency scores, SEEPS, distributions and breakdowns."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspark.catalog.fixtures import events, view_d, view_e, view_h
from gridspark.catalog.q_reshape import STIME, _out
from gridspark.catalog.registry import query, r, rd, sts, ts
from gridspark.operators import align, contingency, distribution, evaluate, losses, normalize, scores, seeps
from gridspark.plans.verify import verification_table
from gridspark.session import scratch_dir, stored

VARS = ["t_in", "p_in", "t_tar"]


@query("verify_by_hour", f"""
WITH S AS (SELECT time, sqrt(avg(power(fcst - ref_, 2))) AS rmse FROM H GROUP BY time)
SELECT hour(time) AS hour, {r('avg(rmse)')} AS rmse_mean, {r('stddev_pop(rmse)')} AS rmse_std FROM S GROUP BY ALL""")
def verify_by_hour(spark, sf_dir):
    h = view_h(spark, sf_dir)
    fcst = h.select("time", "iy", "ix", F.col("fcst").alias("value"))
    ref = h.select("time", "iy", "ix", F.col("ref_").alias("value"))
    stored = verification_table(fcst, ref, scratch_dir(spark, "verification"))
    hourly = evaluate.score_by_hour(scores.score(stored, "rmse", ["time"]), "rmse")
    return hourly.select("hour", rd("rmse_mean").alias("rmse_mean"), rd("rmse_std").alias("rmse_std"))


@query("zscore_stats", " UNION ALL ".join(
    f"SELECT iy, ix, '{v}' AS variable, {r(f'avg({v})', 4)} AS mu, {r(f'stddev_pop({v})', 4)} AS sigma FROM D GROUP BY ALL"
    for v in VARS))
def zscore_stats(spark, sf_dir):
    st = normalize.zscore_stats(view_d(spark, sf_dir), VARS, ["iy", "ix"])
    return st.select("iy", "ix", "variable", rd("mu", 4).alias("mu"), rd("sigma", 4).alias("sigma"))


@query("zscore_normalize", f"""
WITH S AS (SELECT avg(t_in) AS m1, stddev_pop(t_in) AS s1, avg(p_in) AS m2, stddev_pop(p_in) AS s2 FROM D)
SELECT {STIME}, {r('(t_in - m1) / s1')} AS t_in, {r('(p_in - m2) / s2')} AS p_in FROM D, S s""")
def zscore_normalize(spark, sf_dir):
    return _out(normalize.zscore_normalize(view_d(spark, sf_dir), ["t_in", "p_in"]), "t_in", "p_in")


@query("zscore_denormalize", f"""
WITH S AS (SELECT avg(p_in) AS m, stddev_pop(p_in) AS s FROM D)
SELECT {STIME}, {r('t_in * s.s + s.m', 4)} AS t_in, {r('t_tar')} AS t_tar FROM D, S s""")
def zscore_denormalize(spark, sf_dir):
    d = view_d(spark, sf_dir)
    # t_in as if it were model output in units of p_in; t_tar goes there and back
    other = normalize.zscore_stats(d, ["p_in"]).withColumn("variable", F.lit("t_in"))
    own = normalize.zscore_stats(d, ["t_tar"])
    there = normalize.zscore_normalize(d, ["t_tar"], own)
    back = normalize.zscore_denormalize(there, ["t_tar"], own)
    return normalize.zscore_denormalize(back, ["t_in"], other).select(
        ts().alias("time"), "iy", "ix", rd("t_in", 4).alias("t_in"), rd("t_tar").alias("t_tar"))


@query("zscore_per_cell", f"""
WITH T AS (SELECT * FROM H WHERE day(time) <= 15),
C AS (SELECT iy, ix, avg(fcst) AS m, stddev_pop(fcst) AS s FROM T GROUP BY ALL),
G AS (SELECT avg(ref_) AS m, stddev_pop(ref_) AS s FROM T)
SELECT {sts('h.time')} AS time, h.iy, h.ix, {r('(h.fcst - c.m) / nullif(c.s, 0)')} AS fcst, {r('(h.ref_ - g.m) / g.s')} AS ref_
FROM H h LEFT JOIN C c ON c.iy = h.iy AND c.ix = h.ix, G g WHERE day(h.time) > 15""")
def zscore_per_cell(spark, sf_dir):
    h = view_h(spark, sf_dir)
    day = F.dayofmonth("time")
    return _out(normalize.normalize_per_cell(h.where(day > 15), ["fcst"], ["ref_"], h.where(day <= 15)), "fcst", "ref_")


def _simple(name: str, sql: str):
    """A score per time step of E."""
    @query(f"score_{name}", f"SELECT t, {r(sql)} AS {name} FROM E GROUP BY t")
    def build(spark, sf_dir):
        return scores.score(view_e(spark, sf_dir), name, ["t"]).select("t", rd(name).alias(name))
    return build


_simple("bias", "avg(fcst - ref_)")
_simple("mae", "avg(abs(fcst - ref_))")
_simple("mse", "avg(power(fcst - ref_, 2))")
_simple("rmse", "sqrt(avg(power(fcst - ref_, 2)))")


@query("score_l1", f"SELECT {r('sum(abs(fcst - ref_)) / (count(DISTINCT iy) * count(DISTINCT ix))')} AS l1 FROM E")
def score_l1(spark, sf_dir):
    return scores.score(view_e(spark, sf_dir), "l1", avg_dims=["iy", "ix"]).select(rd("l1").alias("l1"))


@query("score_l2", f"SELECT {r('sum(power(fcst - ref_, 2)) / (count(DISTINCT iy) * count(DISTINCT ix))')} AS l2 FROM E")
def score_l2(spark, sf_dir):
    return scores.score(view_e(spark, sf_dir), "l2", avg_dims=["iy", "ix"]).select(rd("l2").alias("l2"))


@query("score_psnr", f"SELECT t, {r('20 * log10(1 / sqrt(avg(power(fcst - ref_, 2))))')} AS psnr FROM E GROUP BY t")
def score_psnr(spark, sf_dir):
    return scores.score(view_e(spark, sf_dir), "psnr", ["t"]).select("t", rd("psnr").alias("psnr"))


@query("score_acc", f"""
WITH C AS (SELECT iy, ix, avg(ref_) AS m FROM H GROUP BY ALL),
A AS (SELECT h.time, h.fcst - c.m AS f, h.ref_ - c.m AS o FROM H h JOIN C c ON c.iy = h.iy AND c.ix = h.ix),
S AS (SELECT time, sum(f * o) AS fo, sum(f * f) * sum(o * o) AS d1, sum(f) * sum(o) AS d2 FROM A GROUP BY time),
P AS (SELECT hour(time) AS hour, CASE WHEN d1 > 0 THEN fo / sqrt(d1) END AS a1, CASE WHEN d2 > 0 THEN fo / sqrt(d2) END AS a2 FROM S)
SELECT hour, {r('avg(a1)')} AS acc, {r('avg(a2)', 4)} AS acc_as_written FROM P GROUP BY hour""")
def score_acc(spark, sf_dir):
    h = view_h(spark, sf_dir)
    ano = align.anomalies(h, align.climatology(h, "ref_"), ["fcst", "ref_"]).withColumn("hour", F.hour("time"))
    both = [scores.score(ano, "acc", ["hour"], each=["time"], variant=v) for v in ("textbook", "as_written")]
    joined = both[0].join(both[1].withColumnRenamed("acc", "acc_as_written"), "hour")
    return joined.select("hour", rd("acc").alias("acc"), rd("acc_as_written", 4).alias("acc_as_written"))


COUNTS = """SELECT iy, ix, count(*) FILTER (WHERE fcst >= 50 AND ref_ >= 50) AS a,
  count(*) FILTER (WHERE fcst >= 50 AND ref_ < 50) AS b, count(*) FILTER (WHERE fcst < 50 AND ref_ >= 50) AS c,
  count(*) FILTER (WHERE fcst < 50 AND ref_ < 50) AS d FROM H GROUP BY ALL"""


@query("contingency_2x2", COUNTS)
def contingency_2x2(spark, sf_dir):
    return contingency.event_counts(view_h(spark, sf_dir), 50.0, ["iy", "ix"])


def _event_score(name: str, sql: str):
    @query(f"score_{name}", f"WITH K AS ({COUNTS}) SELECT iy, ix, {r(sql)} AS {name} FROM K")
    def build(spark, sf_dir):
        df = scores.score(view_h(spark, sf_dir), name, ["iy", "ix"], thresh=50.0)
        return df.select("iy", "ix", rd(name).alias(name))
    return build


_event_score("ets", "(a - (a + b) * (a + c) / (a + b + c + d)) / nullif(a + b + c - (a + b) * (a + c) / (a + b + c + d), 0)")
_event_score("fbi", "(a + b) / nullif(a + c, 0)")
_event_score("pss", "(a * d - b * c) / nullif((a + c) * (b + d), 0)")

CLIM = """SELECT iy, ix, avg(CASE WHEN ref_ <= 5 THEN 1.0 ELSE 0 END) AS p1,
  avg(CASE WHEN ref_ >= t3 THEN 1.0 ELSE 0 END) AS p3, 5.0 AS t1, max(t3) AS t3
  FROM (SELECT h.iy, h.ix, h.ref_, q.t3 FROM H h JOIN (SELECT iy, ix, quantile_cont(ref_, 2.0 / 3) AS t3
    FROM H WHERE ref_ > 5 GROUP BY ALL) q ON q.iy = h.iy AND q.ix = h.ix) GROUP BY ALL"""
WEIGHTS = """SELECT iy, ix, t1, t3, unnest(range(9)) AS idx, unnest([CASE WHEN p3 <> 1 THEN 0 END, 1 / nullif(1 - p1, 0),
  1 / nullif(p3, 0) + 1 / nullif(1 - p1, 0), 1 / nullif(p1, 0), CASE WHEN p3 <> 1 THEN 0 END, 1 / nullif(p3, 0),
  1 / nullif(p1, 0) + 1 / nullif(1 - p3, 0), 1 / nullif(1 - p3, 0), CASE WHEN p3 <> 1 THEN 0 END]) AS w FROM K"""


@query("seeps_climatology", f"""WITH K AS ({CLIM})
SELECT iy, ix, {r('p1')} AS p1, {r('p3')} AS p3, {r('t1')} AS t1, {r('t3')} AS t3 FROM K""")
def seeps_climatology(spark, sf_dir):
    df = seeps.seeps_climatology(stored(view_h(spark, sf_dir), "verification"))
    return df.select("iy", "ix", *[rd(c).alias(c) for c in ("p1", "p3", "t1", "t3")])


@query("seeps_matrix", f"""WITH K AS ({CLIM}), W AS ({WEIGHTS})
SELECT iy, ix, CAST(idx AS INT) AS idx, {r('w')} AS w FROM W""")
def seeps_matrix(spark, sf_dir):
    df = seeps.seeps_matrix(seeps.seeps_climatology(stored(view_h(spark, sf_dir), "verification")))
    return df.select("iy", "ix", "idx", rd("w").alias("w"))


@query("score_seeps", f"""WITH K AS ({CLIM}), W AS ({WEIGHTS})
SELECT {sts('h.time')} AS time, {r('avg(1 - w.w)')} AS seeps FROM H h JOIN W w ON w.iy = h.iy AND w.ix = h.ix
  AND w.idx = 3 * (CAST(h.fcst > t1 AS INT) + CAST(h.fcst >= t3 AS INT)) + CAST(h.ref_ > t1 AS INT) + CAST(h.ref_ >= t3 AS INT)
GROUP BY h.time""")
def score_seeps(spark, sf_dir):
    h = stored(view_h(spark, sf_dir), "verification")
    df = seeps.seeps(h, seeps.seeps_climatology(h), ["time"])
    return df.select(ts().alias("time"), rd("seeps").alias("seeps"))


def cdf_sql(nodes: list[float]) -> str:
    """Distribution of both variables at the nodes by comparing every value with every node."""
    return f"""WITH V AS (SELECT 'fcst' AS variable, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS v FROM events
    UNION ALL SELECT 'ref_', value FROM events),
  X AS (SELECT unnest({nodes}) AS x),
  C AS (SELECT variable, CAST(x AS DOUBLE) AS x, count(*) AS n, count(*) FILTER (WHERE v <= x) AS c,
    max(v) FILTER (WHERE v <= x) AS lo, min(v) FILTER (WHERE v > x) AS hi FROM V, X WHERE v > 0 GROUP BY ALL),
  K AS (SELECT variable, x, CASE WHEN n < 2 THEN NULL WHEN c = 0 THEN 0 WHEN c = n THEN 1
    ELSE (c - 1 + (x - lo) / (hi - lo)) / (n - 1) END AS cdf FROM C)"""


@query("ecdf_at_nodes", f"{cdf_sql(distribution.NODES_1H)} SELECT variable, {r('x')} AS node, {r('cdf', 8)} AS cdf FROM K")
def ecdf_at_nodes(spark, sf_dir):
    df = distribution.ecdf_at_nodes(events(spark, sf_dir), ["fcst", "ref_"], distribution.NODES_1H)
    return df.select("variable", rd("node").alias("node"), rd("cdf", 8).alias("cdf"))


@query("score_iqd", f"""{cdf_sql(distribution.NODES_LONG)},
P AS (SELECT x, max(cdf) FILTER (WHERE variable = 'fcst') AS f, max(cdf) FILTER (WHERE variable = 'ref_') AS o
  FROM K GROUP BY x),
T AS (SELECT x, power(o - f, 2) AS d, lag(x) OVER (ORDER BY x) AS x0, lag(power(o - f, 2)) OVER (ORDER BY x) AS d0, f, o FROM P)
SELECT {r('sum((d + d0) / 2 * (x - x0))', 8)} AS iqd, max(f) >= 0.999 AND max(o) >= 0.999 AS complete FROM T""")
def score_iqd(spark, sf_dir):
    return distribution.iqd(events(spark, sf_dir)).select(rd("iqd", 8).alias("iqd"), "complete")


@query("score_iqd_by_hour", f"""
WITH V AS (SELECT hour(time) AS hour, 'fcst' AS variable, fcst AS v FROM H WHERE fcst > 0
  UNION ALL SELECT hour(time), 'ref_', ref_ FROM H WHERE ref_ > 0),
S AS (SELECT hour, variable, v, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY hour, variable) AS n,
  lead(v) OVER w AS v2 FROM V WINDOW w AS (PARTITION BY hour, variable ORDER BY v)),
X AS (SELECT unnest([0.0, 50.0, 100.0, 200.0, 400.0, 800.0]) AS x),
K AS (SELECT hour, variable, x, max(CASE WHEN n < 2 THEN NULL WHEN v <= x AND v2 IS NULL THEN 1.0
    WHEN v <= x AND v2 > x THEN (k + (x - v) / (v2 - v)) / (n - 1) WHEN k = 0 AND v > x THEN 0.0 END) AS cdf
  FROM S, X GROUP BY ALL),
P AS (SELECT hour, x, max(cdf) FILTER (WHERE variable = 'fcst') AS f, max(cdf) FILTER (WHERE variable = 'ref_') AS o FROM K GROUP BY ALL),
T AS (SELECT hour, x, power(o - f, 2) AS d, lag(x) OVER w AS x0, lag(power(o - f, 2)) OVER w AS d0 FROM P
  WINDOW w AS (PARTITION BY hour ORDER BY x))
SELECT CAST(hour AS INT) AS hour, {r('sum((d + d0) / 2 * (x - x0))', 6)} AS iqd FROM T GROUP BY hour""")
def score_iqd_by_hour(spark, sf_dir):
    df = view_h(spark, sf_dir).withColumn("hour", F.hour("time"))
    return scores.score(df, "iqd", ["hour"], nodes=[0, 50, 100, 200, 400, 800]).select("hour", rd("iqd").alias("iqd"))


def _panel_sql(label: str, cond: str, target: str) -> str:
    return f"""SELECT '{label}' AS factorization, b + 0.5 AS bin_center, {r('q05')} AS q05, {r('q50')} AS q50, {r('q95')} AS q95
  FROM (SELECT unnest(range(CAST(least(floor(min(fcst)), floor(min(ref_))) AS BIGINT),
      CAST(greatest(ceil(max(fcst)), ceil(max(ref_))) AS BIGINT))) AS b FROM H)
  LEFT JOIN (SELECT CAST(floor({cond}) AS BIGINT) AS b, quantile_cont({target}, 0.05) AS q05,
      quantile_cont({target}, 0.5) AS q50, quantile_cont({target}, 0.95) AS q95 FROM H
    WHERE {cond} < (SELECT ceil(max({cond})) FROM H) GROUP BY 1) USING (b)"""


@query("conditional_quantiles", _panel_sql("calibration_refinement", "fcst", "ref_") + " UNION ALL "
       + _panel_sql("likelihood-base_rate", "ref_", "fcst"))
def conditional_quantiles(spark, sf_dir):
    h = stored(view_h(spark, sf_dir), "verification")
    return distribution.conditional_panels(h).select(
        "factorization", F.col("bin_center").cast("double").alias("bin_center"),
        *[rd(c).alias(c) for c in ("q05", "q50", "q95")])


HSCORE = "SELECT time, sqrt(avg(power(fcst - ref_, 2))) AS rmse FROM H GROUP BY time"


def _h_rmse(spark, sf_dir):
    return scores.scores_by(view_h(spark, sf_dir), ["rmse"], ["time"])


@query("global_summary", f"WITH S AS ({HSCORE}) SELECT {r('avg(rmse)')} AS rmse_mean, {r('stddev_pop(rmse)')} AS rmse_std FROM S")
def global_summary(spark, sf_dir):
    df = evaluate.mean_std(_h_rmse(spark, sf_dir), "rmse")
    return df.select(rd("rmse_mean").alias("rmse_mean"), rd("rmse_std").alias("rmse_std"))


@query("score_by_hour", f"""WITH S AS ({HSCORE})
SELECT hour(time) AS hour, {r('avg(rmse)')} AS rmse_mean, {r('stddev_pop(rmse)')} AS rmse_std FROM S GROUP BY ALL""")
def score_by_hour(spark, sf_dir):
    df = evaluate.score_by_hour(_h_rmse(spark, sf_dir), "rmse")
    return df.select("hour", rd("rmse_mean").alias("rmse_mean"), rd("rmse_std").alias("rmse_std"))


SEASON = """CASE WHEN month(time) IN (12, 1, 2) THEN 'DJF' WHEN month(time) <= 5 THEN 'MAM'
  WHEN month(time) <= 8 THEN 'JJA' ELSE 'SON' END"""


@query("score_by_season_hour", f"""
WITH S AS (SELECT time, sqrt(avg(power(t_in - t_tar, 2))) AS rmse FROM D GROUP BY time),
P AS (SELECT {SEASON} AS season, hour(time) AS hour, rmse FROM S)
SELECT coalesce(season, 'all') AS season, coalesce(hour, -1) AS hour, {r('avg(rmse)')} AS rmse_mean,
  {r('stddev_pop(rmse)')} AS rmse_std FROM P GROUP BY GROUPING SETS ((season, hour), (hour), (season), ())""")
def score_by_season_hour(spark, sf_dir):
    per_time = view_d(spark, sf_dir).groupBy("time").agg(scores.rmse("t_in", "t_tar").alias("rmse"))
    df = evaluate.score_breakdown(per_time, "rmse")
    return df.select(F.coalesce("season", F.lit("all")).alias("season"), F.coalesce("hour", F.lit(-1)).alias("hour"),
                     rd("rmse_mean").alias("rmse_mean"), rd("rmse_std").alias("rmse_std"))


def _map_sql(view: str, f: str, o: str, by: str = "") -> str:
    return f"""SELECT {by} iy, ix, {r(f'avg({f} - {o})', 8)} AS bias, {r(f'avg(abs({f} - {o}))', 8)} AS abs_error_mean,
  {r(f'sqrt(avg(power({f} - {o}, 2)))', 8)} AS rmse FROM {view} GROUP BY ALL"""


MAP = ("bias", "abs_error_mean", "rmse")


@query("score_map_mean", _map_sql("E", "fcst", "ref_"))
def score_map_mean(spark, sf_dir):
    return evaluate.score_map(view_e(spark, sf_dir)).select("iy", "ix", *[rd(c, 8).alias(c) for c in MAP])


@query("score_map_by_hour", _map_sql("H", "fcst", "ref_", "hour(time) AS hour,"))
def score_map_by_hour(spark, sf_dir):
    df = evaluate.score_map(view_h(spark, sf_dir), ["hour"])
    return df.select("hour", "iy", "ix", *[rd(c, 8).alias(c) for c in MAP])


@query("score_map_season_hour", _map_sql("D", "t_in", "t_tar", f"{SEASON} AS season, hour(time) AS hour,"))
def score_map_season_hour(spark, sf_dir):
    df = evaluate.score_map(view_d(spark, sf_dir), ["season", "hour"], fcst="t_in", ref="t_tar")
    return df.select("season", "hour", "iy", "ix", *[rd(c, 8).alias(c) for c in MAP])


PAIRS = [("t_tar", "t_in"), ("p_ref", "p_sim")]


def _channels(spark, sf_dir):
    return view_d(spark, sf_dir).withColumns({"p_ref": F.col("t_tar") * 1.5, "p_sim": F.col("p_in") / 1000})


@query("loss_channels", f"""
SELECT year(time) AS year, {r('avg(abs(t_tar - t_in)) + avg(abs(t_tar * 1.5 - p_in / 1000))')} AS mae,
  {r('(avg(power(t_tar - t_in, 2)) + avg(power(t_tar * 1.5 - p_in / 1000, 2))) / 2')} AS mse_mean FROM D GROUP BY ALL""")
def loss_channels(spark, sf_dir):
    df = _channels(spark, sf_dir).withColumn("year", F.year("time"))
    mae = losses.loss_channels(df, PAIRS, by=["year"]).withColumnRenamed("loss", "mae")
    mse = losses.loss_channels(df, PAIRS, squared=True, average=True, by=["year"]).withColumnRenamed("loss", "mse_mean")
    return mae.join(mse, "year").select("year", rd("mae").alias("mae"), rd("mse_mean").alias("mse_mean"))


@query("loss_vector", f"""
SELECT year(time) AS year, {r('avg(sqrt(power(t_tar - t_in, 2) + power(t_tar * 1.5 - p_in / 1000, 2)))')} AS mae,
  {r('avg(power(t_tar - t_in, 2)) + avg(power(t_tar * 1.5 - p_in / 1000, 2))')} AS mse FROM D GROUP BY ALL""")
def loss_vector(spark, sf_dir):
    df = _channels(spark, sf_dir).withColumn("year", F.year("time"))
    mae = losses.loss_vector(df, PAIRS, by=["year"]).withColumnRenamed("loss", "mae")
    mse = losses.loss_vector(df, PAIRS, n_vector=1, squared=True, by=["year"]).withColumnRenamed("loss", "mse")
    return mae.join(mse, "year").select("year", rd("mae").alias("mae"), rd("mse").alias("mse"))


@query("boxplot_stats", f"""
WITH Q AS (SELECT cell, quantile_cont(ref_, 0.25) AS q1, quantile_cont(ref_, 0.5) AS median,
  quantile_cont(ref_, 0.75) AS q3 FROM H GROUP BY cell),
J AS (SELECT h.cell, h.ref_ AS v, q1, median, q3, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi
  FROM H h JOIN Q q ON q.cell = h.cell)
SELECT cell, {r('max(q1)')} AS q1, {r('max(median)')} AS median, {r('max(q3)')} AS q3,
  {r('min(v) FILTER (WHERE v >= lo)')} AS whisker_lo, {r('max(v) FILTER (WHERE v <= hi)')} AS whisker_hi,
  {r('max(v) FILTER (WHERE v < lo OR v > hi)')} AS outlier_max FROM J GROUP BY cell""")
def boxplot_stats(spark, sf_dir):
    df = evaluate.boxplot_stats(stored(view_h(spark, sf_dir), "verification"), "ref_", ["cell"])
    return df.select("cell", *[rd(c).alias(c) for c in
                               ("q1", "median", "q3", "whisker_lo", "whisker_hi", "outlier_max")])


@query("dataset_info", """
WITH G AS (SELECT date_trunc('month', time) AS m, count(DISTINCT time) AS n FROM D GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS samples, max(n) AS max_samples, count(*) AS groups,
  (SELECT count(*) FROM (SELECT DISTINCT iy, ix FROM D)) AS cells FROM G""")
def dataset_info(spark, sf_dir):
    return evaluate.dataset_info(view_d(spark, sf_dir).withColumn("month", F.date_trunc("month", "time")), "month")


@query("baseline_difference", f"""
SELECT iy, ix, {r('avg(t_in - t_tar)')} AS input_error, {r('avg(p_in / 1000 - t_tar)')} AS downscaled_error
FROM D GROUP BY ALL""")
def baseline_difference(spark, sf_dir):
    d = view_d(spark, sf_dir).withColumn("fine", F.col("p_in") / 1000)
    df = evaluate.baseline_difference(d, "t_in", "fine", "t_tar")
    return df.select("iy", "ix", rd("input_error").alias("input_error"), rd("downscaled_error").alias("downscaled_error"))


@query("score_registry", " UNION ALL ".join(
    f"SELECT '{n}' AS score, {r(s)} AS value FROM H" for n, s in {
        "bias": "avg(fcst - ref_)", "mae": "avg(abs(fcst - ref_))", "mse": "avg(power(fcst - ref_, 2))",
        "rmse": "sqrt(avg(power(fcst - ref_, 2)))", "psnr": "20 * log10(100 / sqrt(avg(power(fcst - ref_, 2))))",
        "fbi": "count(*) FILTER (WHERE fcst >= 50) / count(*) FILTER (WHERE ref_ >= 50)"}.items()))
def score_registry(spark, sf_dir):
    h = view_h(spark, sf_dir)
    options = {"psnr": {"pixel_max": 100.0}, "fbi": {"thresh": 50.0}}
    out = None
    for name in ("bias", "mae", "mse", "rmse", "psnr", "fbi"):
        one = scores.score(h, name, **options.get(name, {})).select(F.lit(name).alias("score"), rd(name).alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


@query("worst_times", f"""WITH S AS ({HSCORE})
SELECT {sts()} AS time, {r('rmse')} AS rmse FROM S ORDER BY rmse DESC, S.time LIMIT 20""")
def worst_times(spark, sf_dir):
    df = evaluate.worst_times(_h_rmse(spark, sf_dir), "rmse", 20)
    return df.select(ts().alias("time"), rd("rmse").alias("rmse"))


@query("level_bins", f"""
SELECT CAST(CASE WHEN d < -0.4 THEN 0 WHEN d >= 0.4 THEN 17 ELSE floor((d + 0.4) / 0.05) + 1 END AS BIGINT) AS bin,
  count(*) AS n FROM (SELECT fcst - ref_ AS d FROM E) GROUP BY 1""")
def level_bins(spark, sf_dir):
    d = F.col("fcst") - F.col("ref_")
    return view_e(spark, sf_dir).groupBy(evaluate.level_bins(d, -0.4, 0.4, 16).alias("bin")).agg(F.count("*").alias("n"))
