"""Joins, alignment and regridding."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspark.catalog.fixtures import GRID_E, table, view_d, view_e, view_h, view_l, view_z
from gridspark.catalog.q_reshape import STIME, _out
from gridspark.catalog.registry import query, r, rd, sts, ts
from gridspark.functions.calendar import forecast_run, plus_hours
from gridspark.operators import align, grid, regrid, vertical
from gridspark.operators.evaluate import mean_std, with_time_parts
from gridspark.operators.grid import Grid
from gridspark.operators.scores import scores_by
from gridspark.plans.prepare import coarsen_then_refine


@query("merge_on_time_intersection", f"""
SELECT {sts('a.time')} AS time, a.iy, a.ix, {r('a.t_in')} AS t_in, {r('b.p_in')} AS p_in
FROM D a JOIN D b ON b.time = a.time AND b.iy = a.iy AND b.ix = a.ix WHERE year(a.time) BETWEEN 1996 AND 1998""")
def merge_on_time_intersection(spark, sf_dir):
    d = view_d(spark, sf_dir)
    a = d.where(F.year("time") <= 1998).select("time", "iy", "ix", "t_in")
    b = d.where(F.year("time") >= 1996).select("time", "iy", "ix", "p_in")
    return _out(align.merge_on_time_intersection(a, b), "t_in", "p_in")


@query("merge_variables", f"""
SELECT {sts('coalesce(a.time, b.time)')} AS time, coalesce(a.iy, b.iy) AS iy, coalesce(a.ix, b.ix) AS ix,
  {r('coalesce(a.t_in, 2 * b.t_in)')} AS t_in, {r('a.t_tar')} AS t_tar, {r('b.p_in')} AS p_in
FROM (SELECT * FROM D WHERE iy < 2) a FULL JOIN (SELECT * FROM D WHERE iy > 0) b
  ON b.time = a.time AND b.iy = a.iy AND b.ix = a.ix""")
def merge_variables(spark, sf_dir):
    d = view_d(spark, sf_dir)
    a = d.where("iy < 2").select("time", "iy", "ix", "t_in", "t_tar")
    b = d.where("iy > 0").select("time", "iy", "ix", (2 * F.col("t_in")).alias("t_in"), "p_in")
    return _out(align.merge_variables(a, b), "t_in", "t_tar", "p_in")


@query("align_fcst_ref", f"SELECT t, iy, ix, {r('fcst - ref_')} AS diff FROM E")
def align_fcst_ref(spark, sf_dir):
    from gridspark.catalog.fixtures import e_rows

    emb = table(spark, sf_dir, "embeddings")
    fcst = e_rows(emb.select((F.col("vec_id") - 1).alias("t"), "embedding"), "embedding")
    ref = e_rows(emb.select(F.col("vec_id").alias("t"), "embedding"), "embedding")
    both = align.align_fcst_ref(fcst, ref, ["t", "iy", "ix"])
    return both.select("t", "iy", "ix", rd(F.col("fcst") - F.col("ref_")).alias("diff"))


@query("anomaly_vs_climatology", f"""
SELECT {sts('h.time')} AS time, h.iy, h.ix, {r('h.fcst - c.m')} AS fcst_ano, {r('h.ref_ - c.m')} AS ref__ano
FROM H h JOIN (SELECT iy, ix, avg(ref_) AS m FROM H GROUP BY ALL) c ON c.iy = h.iy AND c.ix = h.ix""")
def anomaly_vs_climatology(spark, sf_dir):
    h = view_h(spark, sf_dir)
    df = align.anomalies(h, align.climatology(h, "ref_"), ["fcst", "ref_"])
    return _out(df, "fcst_ano", "ref__ano")


CON_GRID = Grid(3, 3, 6.5, 1.2, 51.0, -1.2)


def con_sql(source: str, dst: Grid, src: Grid, values: list[str], key: str) -> str:
    """Conservative means by an overlap join of all cells."""
    def bounds(g: Grid, a: str, y: str, x: str) -> dict[str, str]:
        lon, lat = f"({g.x0} + {g.dx} * {a}.{x})", f"({g.y0} + {g.dy} * {a}.{y})"
        hx, hy = abs(g.dx) / 2, abs(g.dy) / 2
        return {"w": f"({lon} - {hx})", "e": f"({lon} + {hx})", "s": f"({lat} - {hy})", "n": f"({lat} + {hy})"}
    s, t = bounds(src, "d", "iy", "ix"), bounds(dst, "c", "ty", "tx")
    w, e = f"greatest({s['w']}, {t['w']})", f"least({s['e']}, {t['e']})"
    lo, hi = f"greatest({s['s']}, {t['s']})", f"least({s['n']}, {t['n']})"
    area = f"(radians({e}) - radians({w})) * (sin(radians({hi})) - sin(radians({lo})))"
    cells = f"SELECT CAST(y AS INT) AS ty, CAST(x AS INT) AS tx FROM range({dst.ny}) a(y), range({dst.nx}) b(x)"
    means = ", ".join(f"sum(w * {v}) / nullif(sum(w) FILTER (WHERE {v} IS NOT NULL), 0) AS {v}" for v in values)
    return f"""SELECT {key}, ty AS iy, tx AS ix, {means} FROM (
  SELECT d.*, c.ty, c.tx, {area} AS w FROM {source} d JOIN ({cells}) c
  ON {e} - {w} > 1e-12 AND {hi} - {lo} > 1e-12) GROUP BY {key}, ty, tx"""


@query("remap_conservative", f"""
WITH S AS (SELECT t, iy, ix, CASE WHEN (t + iy) % 7 = 0 AND ix > 4 THEN NULL ELSE fcst END AS fcst, ref_ FROM E),
R AS ({con_sql('S', CON_GRID, GRID_E, ['fcst', 'ref_'], 't')})
SELECT t, iy, ix, {r('fcst', 8)} AS fcst, {r('ref_', 8)} AS ref_ FROM R""")
def remap_conservative(spark, sf_dir):
    gap = (F.col("t") + F.col("iy")) % 7 == 0
    e = view_e(spark, sf_dir).withColumn("fcst", F.when(~(gap & (F.col("ix") > 4)), F.col("fcst")))
    df = regrid.remap_conservative(e, GRID_E, CON_GRID, ["fcst", "ref_"], ["t"])
    return df.select("t", "iy", "ix", rd("fcst", 8).alias("fcst"), rd("ref_", 8).alias("ref_"))


BIL_GRID = Grid(5, 6, 5.8, 0.9, 51.8, -0.75)


def bil_sql(source: str, dst: Grid, src: Grid, values: list[str], key: str) -> str:
    fx = f"(({dst.x0} + {dst.dx} * x - {src.x0}) / {src.dx})"
    fy = f"(({dst.y0} + {dst.dy} * y - {src.y0}) / {src.dy})"
    cells = f"""SELECT CAST(y AS INT) AS ty, CAST(x AS INT) AS tx, {fx} AS fx, {fy} AS fy,
      CAST(greatest(0, least({src.nx - 2}, floor({fx}))) AS INT) AS i0,
      CAST(greatest(0, least({src.ny - 2}, floor({fy}))) AS INT) AS j0
      FROM range({dst.ny}) a(y), range({dst.nx}) b(x)"""
    corners = ", ".join(f"max({v}) FILTER (WHERE dy = {j} AND dx = {i}) AS {v}{j}{i}"
                        for v in values for j in (0, 1) for i in (0, 1))
    value = ", ".join(
        f"({v}00 * (1 - (fx - i0)) + {v}01 * (fx - i0)) * (1 - (fy - j0))"
        f" + ({v}10 * (1 - (fx - i0)) + {v}11 * (fx - i0)) * (fy - j0) AS {v}" for v in values)
    return f"""SELECT {key}, ty AS iy, tx AS ix, {value} FROM (
  SELECT d.{key}, ty, tx, fx, fy, i0, j0, {corners} FROM (
    SELECT d.*, c.*, d.iy - c.j0 AS dy, d.ix - c.i0 AS dx FROM {source} d JOIN ({cells}) c
    ON d.iy BETWEEN c.j0 AND c.j0 + 1 AND d.ix BETWEEN c.i0 AND c.i0 + 1) d GROUP BY ALL)"""


@query("remap_bilinear", f"""
WITH R AS ({bil_sql('E', BIL_GRID, GRID_E, ['fcst', 'ref_'], 't')})
SELECT t, iy, ix, {r('fcst', 8)} AS fcst, {r('ref_', 8)} AS ref_ FROM R""")
def remap_bilinear(spark, sf_dir):
    df = regrid.remap_bilinear(view_e(spark, sf_dir), GRID_E, BIL_GRID, ["fcst", "ref_"], ["t"])
    return df.select("t", "iy", "ix", rd("fcst", 8).alias("fcst"), rd("ref_", 8).alias("ref_"))


# fields around the globe, and targets across their first meridian, some beyond the fields
GLOBE, TURNS = Grid(8, 8, 0.0, 45.0, 48.0, 0.5), Grid(24, 8, -360.0, 45.0, 48.0, 0.5)
WRAP_GRID = Grid(6, 5, -70.0, 25.0, 47.0, 1.2)
TURNED = "SELECT t, iy, CAST(ix + k AS INT) AS ix, fcst FROM E, (SELECT unnest([0, 8, 16]) AS k)"


@query("remap_conservative_wrap", f"""
WITH S AS ({TURNED}), R AS ({con_sql('S', WRAP_GRID, TURNS, ['fcst'], 't')}),
C AS (SELECT t, CAST(y AS INT) AS iy, CAST(x AS INT) AS ix FROM (SELECT DISTINCT t FROM E), range(5) a(y), range(6) b(x))
SELECT C.t, C.iy, C.ix, {r('R.fcst', 8)} AS fcst FROM C LEFT JOIN R ON R.t = C.t AND R.iy = C.iy AND R.ix = C.ix""")
def remap_conservative_wrap(spark, sf_dir):
    df = regrid.remap_conservative(view_e(spark, sf_dir), GLOBE, WRAP_GRID, ["fcst"], ["t"])
    return df.select("t", "iy", "ix", rd("fcst", 8).alias("fcst"))


@query("remap_bilinear_wrap", f"""
WITH S AS ({TURNED}), R AS ({bil_sql('S', WRAP_GRID, TURNS, ['fcst'], 't')})
SELECT t, iy, ix, {r('fcst', 8)} AS fcst FROM R""")
def remap_bilinear_wrap(spark, sf_dir):
    df = regrid.remap_bilinear(view_e(spark, sf_dir), GLOBE, WRAP_GRID, ["fcst"], ["t"])
    return df.select("t", "iy", "ix", rd("fcst", 8).alias("fcst"))


COARSE_E = GRID_E.coarsened(2)


@query("coarsen_then_refine", f"""
WITH ZE AS (SELECT CAST(y AS INT) AS iy, CAST(x AS INT) AS ix, z.z FROM range(8) a(y), range(8) b(x)
  JOIN Z z ON z.iy = y % 3 AND z.ix = x % 4),
S AS (SELECT e.t, e.iy, e.ix, 1004.709 * (280 + e.fcst) + ze.z + 9.80665 * 2 AS temp, e.ref_ AS wind, ze.z
  FROM E e LEFT JOIN ZE ze ON ze.iy = e.iy AND ze.ix = e.ix),
C AS ({con_sql('S', COARSE_E, GRID_E, ['temp', 'wind', 'z'], 't')}),
B AS ({bil_sql('C', GRID_E, COARSE_E, ['temp', 'wind', 'z'], 't')})
SELECT b.t, b.iy, b.ix, {r('(b.temp - b.z - 9.80665 * 2) / 1004.709')} AS temp_in, {r('b.wind')} AS wind_in,
  {r('b.z')} AS z_in, {r('280 + e.fcst')} AS temp_tar, {r('e.ref_')} AS wind_tar
FROM B b JOIN E e ON e.t = b.t AND e.iy = b.iy AND e.ix = b.ix""")
def coarsen_then_refine_(spark, sf_dir):
    e = view_e(spark, sf_dir).select("t", "iy", "ix", (280 + F.col("fcst")).alias("temp"), F.col("ref_").alias("wind"))
    cells = grid.grid_cells(spark, GRID_E).select("iy", "ix", (F.col("iy") % 3).alias("zy"), (F.col("ix") % 4).alias("zx"))
    z = view_z(spark, sf_dir).withColumnsRenamed({"iy": "zy", "ix": "zx"})
    static = cells.join(z, ["zy", "zx"]).select("iy", "ix", "z")
    df = coarsen_then_refine(e, GRID_E, 2, ["temp", "wind"], "temp", static, time="t")
    return df.select("t", "iy", "ix", *[rd(c).alias(c) for c in ("temp_in", "wind_in")], rd("z_in").alias("z_in"),
                     *[rd(c).alias(c) for c in ("temp_tar", "wind_tar")])


TARGETS = [40000, 60000, 85000, 95000, 110000]


@query("vertical_interp", f"""
WITH S AS (SELECT time, iy, ix, level AS p0, t AS t0, lead(level) OVER w AS p1, lead(t) OVER w AS t1,
    row_number() OVER w AS k, count(*) OVER (PARTITION BY time, iy, ix) AS n FROM L
  WINDOW w AS (PARTITION BY time, iy, ix ORDER BY level)),
X AS (SELECT s.*, CAST(q AS DOUBLE) AS plev FROM S s JOIN (SELECT unnest({TARGETS}) AS q) ON p1 IS NOT NULL
  AND (k = 1 OR q > p0) AND (k = n - 1 OR q <= p1))
SELECT {STIME}, plev, {r('t0 + (t1 - t0) * (ln(plev) - ln(p0)) / (ln(p1) - ln(p0))')} AS t FROM X""")
def vertical_interp(spark, sf_dir):
    df = vertical.to_pressure_levels(view_l(spark, sf_dir), TARGETS, ["t"], pressure="level")
    return df.select(ts().alias("time"), "iy", "ix", "plev", rd("t").alias("t"))


# coefficients of six half levels, and the model level that each pressure level of L stands for
HALF = ((0.0, 0.0), (20000.0, 0.1), (30000.0, 0.3), (20000.0, 0.6), (8000.0, 0.85), (0.0, 1.0))
MODEL_LEVELS = {50000: 1, 70000: 2, 85000: 3, 92500: 4, 100000: 5}


@query("vertical_interp_hybrid", f"""
WITH C AS (SELECT unnest({[i for i in range(len(HALF))]}) AS half, unnest({[a for a, _ in HALF]}) AS a, unnest({[b for _, b in HALF]}) AS b),
P AS (SELECT h.time, h.iy, h.ix, u.half + 1 AS k, (u.a + o.a + (u.b + o.b) * (90000 + 50 * h.ref_)) / 2 AS p FROM H h, C u, C o
  WHERE o.half = u.half + 1),
M AS (SELECT time, iy, ix, CASE level {' '.join(f'WHEN {p} THEN {k}' for p, k in MODEL_LEVELS.items())} END AS k, t FROM L),
S AS (SELECT time, iy, ix, p AS p0, t AS t0, lead(p) OVER w AS p1, lead(t) OVER w AS t1,
    row_number() OVER w AS n, count(*) OVER (PARTITION BY time, iy, ix) AS m FROM M JOIN P USING (time, iy, ix, k)
  WINDOW w AS (PARTITION BY time, iy, ix ORDER BY p)),
X AS (SELECT s.*, CAST(q AS DOUBLE) AS plev FROM S s JOIN (SELECT unnest({TARGETS}) AS q) ON p1 IS NOT NULL
  AND (n = 1 OR q > p0) AND (n = m - 1 OR q <= p1))
SELECT {STIME}, plev, {r('t0 + (t1 - t0) * (ln(plev) - ln(p0)) / (ln(p1) - ln(p0))')} AS t FROM X""")
def vertical_interp_hybrid(spark, sf_dir):
    numbered = F.create_map(*[F.lit(x) for pair in MODEL_LEVELS.items() for x in pair])
    levels = view_l(spark, sf_dir).withColumn("k", numbered[F.col("level")])
    surface = view_h(spark, sf_dir).select("time", "iy", "ix", F.ln(90000 + 50 * F.col("ref_")).alias("lnsp")).select(
        "time", "iy", "ix", vertical.surface_pressure(F.col("lnsp")).alias("sp"))
    half = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(HALF)], "half int, a double, b double")
    df = vertical.hybrid_to_pressure_levels(levels, surface, half, TARGETS, ["t"], level="k")
    return df.select(ts().alias("time"), "iy", "ix", "plev", rd("t").alias("t"))


RUN_SQL = """SELECT time, iy, ix, fcst, hour(time) AS h,
  CASE WHEN hour(time) < 12 THEN date_trunc('day', time) - INTERVAL 6 HOUR
    ELSE date_trunc('day', time) + INTERVAL 6 HOUR END AS run_init FROM H"""


@query("forecast_lookup", f"""
SELECT {STIME}, {sts('run_init')} AS run_init,
  CAST(CASE WHEN h < 12 THEN 6 + h ELSE h - 6 END AS INT) AS lead, {r('fcst')} AS run_value FROM ({RUN_SQL})""")
def forecast_lookup(spark, sf_dir):
    h = view_h(spark, sf_dir)
    now = h.withColumns(forecast_run(F.col("time"), "era5", 6))
    # the archive also holds the run 12 hours earlier, which must not be taken
    older = F.explode(F.array(F.lit(0), F.lit(12)))
    runs = now.withColumn("back", older).select(
        plus_hours(F.col("run_init"), -F.col("back")).alias("run_init"), (F.col("lead") + F.col("back")).alias("lead"),
        "iy", "ix", (F.col("fcst") + F.col("back")).alias("run_value"))
    df = align.forecast_lookup(h.select("time", "iy", "ix"), runs)
    return df.select(ts().alias("time"), "iy", "ix", ts("run_init").alias("run_init"), "lead",
                     rd("run_value").alias("run_value"))


@query("attach_coords", f"""
WITH S AS (SELECT avg(label) AS mu, stddev_pop(label) AS sigma FROM embeddings)
SELECT b.vec_id, b.iy, b.ix, {r('48.0 + 0.5 * b.iy')} AS lat, {r('6.0 + 0.5 * b.ix')} AS lon,
  {r('b.val * s.sigma + s.mu')} AS value FROM EB b, S s""")
def attach_coords(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings")
    stats = emb.agg(F.avg("label").alias("mu"), F.stddev_pop("label").alias("sigma"))
    coords = grid.grid_cells(spark, GRID_E).select("iy", "ix", "lat", "lon")
    df = align.attach_coords(emb, "embedding", 8, coords, stats, keys=["vec_id"])
    return df.select("vec_id", "iy", "ix", *[rd(c).alias(c) for c in ("lat", "lon", "value")])


@query("compare_experiments", f"""
WITH P AS (SELECT time, sqrt(avg(power(fcst - ref_, 2))) AS a, sqrt(avg(power(0.5 * fcst - ref_, 2))) AS b
  FROM H GROUP BY time),
X AS (SELECT hour(time) AS hour, avg(a) AS a, avg(b) AS b FROM P GROUP BY ALL)
SELECT hour, {r('a')} AS rmse_mean_base, {r('b')} AS rmse_mean_half, {r('b - a')} AS difference FROM X""")
def compare_experiments(spark, sf_dir):
    h = view_h(spark, sf_dir)
    runs = h.withColumn("exp", F.lit("base")).unionByName(
        h.withColumns({"fcst": 0.5 * F.col("fcst"), "exp": F.lit("half")}))
    hourly = mean_std(with_time_parts(scores_by(runs, ["rmse"], ["exp", "time"])), "rmse", ["exp", "hour"])
    df = align.compare_experiments(hourly, ["base", "half"], "rmse_mean")
    return df.select("hour", *[rd(c).alias(c) for c in ("rmse_mean_base", "rmse_mean_half", "difference")])


def _descriptions(spark, sf_dir, unit=1):
    """A small grid description per part."""
    size, key = F.col("p_size"), F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        "p_partkey", (unit * (1 + size % 4)).cast("int").alias("xsize"), (unit * (1 + key % 3)).cast("int").alias("ysize"),
        (size / 10).cast("double").alias("xfirst"), F.lit(0.25).alias("xinc"),
        (-(size / 5)).cast("double").alias("yfirst"), F.lit(-0.5).alias("yinc"))


@query("grid_cells", f"""
SELECT p_partkey, CAST(y AS INT) AS iy, CAST(x AS INT) AS ix, {r('-p_size / 5 - 0.5 * y')} AS lat,
  {r('p_size / 10 + 0.25 * x')} AS lon, {r('-p_size / 5 - 0.5 * y - 0.25')} AS lat_lo,
  {r('-p_size / 5 - 0.5 * y + 0.25')} AS lat_hi, {r('p_size / 10 + 0.25 * x - 0.125')} AS lon_lo,
  {r('p_size / 10 + 0.25 * x + 0.125')} AS lon_hi
FROM part, range(3) a(y), range(4) b(x) WHERE y <= p_partkey % 3 AND x <= p_size % 4""")
def grid_cells(spark, sf_dir):
    cells = grid.expand_cells(_descriptions(spark, sf_dir))
    return cells.select("p_partkey", "iy", "ix", *[rd(c).alias(c) for c in
                                                   ("lat", "lon", "lat_lo", "lat_hi", "lon_lo", "lon_hi")])


@query("coarsened_grid", f"""
WITH G AS (SELECT p_partkey, 4 * (1 + p_size % 4) AS nx, 4 * (1 + p_partkey % 3) AS ny, p_size / 10 AS x0,
  -p_size / 5 AS y0 FROM part)
SELECT p_partkey, CAST(nx / 4 + 2 AS BIGINT) AS coarse_xsize, CAST(ny / 4 + 2 AS BIGINT) AS coarse_ysize,
  {r('x0 - 2.5 * 0.25')} AS coarse_xfirst, {r('y0 + 2.5 * 0.5')} AS coarse_yfirst, CAST(1.0 AS DOUBLE) AS coarse_xinc,
  CAST(-2.0 AS DOUBLE) AS coarse_yinc, nx + 8 AS base_xsize, ny + 8 AS base_ysize, {r('x0 - 1.0')} AS base_xfirst,
  {r('y0 + 2.0')} AS base_yfirst FROM G""")
def coarsened_grid(spark, sf_dir):
    df = grid.coarsen_table(_descriptions(spark, sf_dir, unit=4), 4)
    return df.select("p_partkey", "coarse_xsize", "coarse_ysize", rd("coarse_xfirst").alias("coarse_xfirst"),
                     rd("coarse_yfirst").alias("coarse_yfirst"), "coarse_xinc", "coarse_yinc", "base_xsize",
                     "base_ysize", rd("base_xfirst").alias("base_xfirst"), rd("base_yfirst").alias("base_yfirst"))
