"""Projections and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspark.catalog.fixtures import view_d, view_e, view_h, view_l, view_z
from gridspark.catalog.registry import query, r, rd, sts, ts
from gridspark.columns import choose_vars
from gridspark.operators import reshape

STIME = f"{sts()} AS time, iy, ix"


def _out(df, *cols, digits=6):
    """Keys and rounded columns."""
    return df.select(ts().alias("time"), "iy", "ix", *[rd(c, digits).alias(c) for c in cols])


@query("split_in_tar", f"""
SELECT {STIME}, 'in' AS side, 2 AS n_vars, {r('t_in + p_in')} AS total FROM D
UNION ALL SELECT {STIME}, 'tar', 1, {r('t_tar')} FROM D""")
def split_in_tar(spark, sf_dir):
    inputs, targets = reshape.split_in_tar(view_d(spark, sf_dir))

    def side(df, name):
        variables = [c for c in df.columns if c not in reshape.KEYS]
        total = sum((F.col(v) for v in variables[1:]), F.col(variables[0]))
        return df.select(ts().alias("time"), "iy", "ix", F.lit(name).alias("side"),
                         F.lit(len(variables)).alias("n_vars"), rd(total).alias("total"))
    return side(inputs, "in").unionByName(side(targets, "tar"))


@query("select_vars_checked", f"SELECT {STIME}, {r('t_in')} AS t_in, {r('t_tar')} AS t_tar FROM D")
def select_vars_checked(spark, sf_dir):
    return _out(reshape.select_vars(view_d(spark, sf_dir), ["t_in", "t_tar"]), "t_in", "t_tar")


@query("tar2in", f"""
SELECT {STIME}, {r('t_tar')} AS t_tar_as_in, {r('t_in')} AS t_in, {r('p_in')} AS p_in, {r('t_tar')} AS t_tar FROM D""")
def tar2in(spark, sf_dir):
    df = reshape.tar2in(view_d(spark, sf_dir), "t_tar", ["t_in", "p_in"])
    return _out(df, "t_tar_as_in", "t_in", "p_in", "t_tar")


@query("wide_to_long", " UNION ALL ".join(
    f"SELECT {STIME}, '{v}' AS variable, {r(v)} AS value FROM D" for v in ("t_in", "p_in", "t_tar")))
def wide_to_long(spark, sf_dir):
    df = reshape.wide_to_long(view_d(spark, sf_dir), ["t_in", "p_in", "t_tar"])
    return df.select(ts().alias("time"), "iy", "ix", "variable", rd("value").alias("value"))


@query("long_to_wide", f"SELECT {STIME}, {r('t_in')} AS t_in, {r('t_tar')} AS t_tar FROM D")
def long_to_wide(spark, sf_dir):
    long = reshape.wide_to_long(view_d(spark, sf_dir), ["t_in", "t_tar"])
    return _out(reshape.long_to_wide(long, ["t_in", "t_tar"]), "t_in", "t_tar")


@query("named_targets", f"SELECT {STIME}, 2 AS n, {r('t_tar')} AS t_tar, {r('p_in')} AS p_in FROM D")
def named_targets(spark, sf_dir):
    df = reshape.named_targets(view_d(spark, sf_dir), ["t_tar", "p_in"])
    return df.select(ts().alias("time"), "iy", "ix", F.size("targets").alias("n"),
                     rd(F.col("targets")["t_tar"]).alias("t_tar"), rd(F.col("targets")["p_in"]).alias("p_in"))


@query("cast_float32", f"""
SELECT {STIME}, {r('CAST(t_in AS FLOAT)', 3)} AS t_in, {r('CAST(t_tar AS FLOAT)', 3)} AS t_tar FROM D""")
def cast_float32(spark, sf_dir):
    df = reshape.cast_float32(view_d(spark, sf_dir), ["t_in", "t_tar"])
    return df.select(ts().alias("time"), "iy", "ix", *[rd(F.col(c).cast("double"), 3).alias(c)
                                                       for c in ("t_in", "t_tar")])


@query("rename_suffix", f"SELECT {STIME}, {r('t_in')} AS t_in_src, {r('p_in')} AS p_in_src FROM D")
def rename_suffix(spark, sf_dir):
    df = reshape.rename_suffix(view_d(spark, sf_dir), ["t_in", "p_in"], "_SRC")
    return _out(df, *choose_vars(df, suffix="_src"))


LEVEL_NAMES = {50000: "t500", 70000: "t700", 85000: "t850", 92500: "t925", 100000: "t1000"}


@query("level_varnames", f"SELECT {STIME}, " + ", ".join(
    r(f"max(t) FILTER (WHERE level = {pa})") + f" AS {name}" for pa, name in LEVEL_NAMES.items())
    + " FROM L GROUP BY time, iy, ix")
def level_varnames(spark, sf_dir):
    df = reshape.levels_to_columns(view_l(spark, sf_dir), "t", list(LEVEL_NAMES))
    return _out(df, *LEVEL_NAMES.values())


@query("rename_coords", f"SELECT t, iy, ix, {r('lat')} AS lat, {r('lon')} AS lon, {r('fcst')} AS fcst FROM E")
def rename_coords(spark, sf_dir):
    raw = view_e(spark, sf_dir).withColumnsRenamed({"lat": "latitude", "lon": "longitude"}).withColumns(
        {"latitude": F.col("latitude").cast("float"), "longitude": F.col("longitude").cast("float")})
    df = reshape.rename_coords(raw)
    return df.select("t", "iy", "ix", *[rd(c).alias(c) for c in ("lat", "lon", "fcst")])


@query("drop_vars", f"SELECT {STIME}, {r('t_tar')} AS t_tar FROM D")
def drop_vars(spark, sf_dir):
    return _out(reshape.drop_vars(view_d(spark, sf_dir), ["t_in", "p_in"]), "t_tar")


@query("broadcast_static", f"""
SELECT {sts('h.time')} AS time, h.iy, h.ix, {r('h.fcst')} AS fcst, {r('z.z')} AS z
FROM H h LEFT JOIN Z z ON z.iy = h.iy AND z.ix = h.ix""")
def broadcast_static(spark, sf_dir):
    df = reshape.broadcast_static(view_h(spark, sf_dir), view_z(spark, sf_dir))
    return df.select(ts().alias("time"), "iy", "ix", rd("fcst").alias("fcst"), rd("z").alias("z"))


@query("dse_roundtrip", f"""
SELECT e.t, e.iy, e.ix, {r('1004.709 * (280 + e.fcst) + z.z + 9.80665 * 2', 4)} AS dse, {r('280 + e.fcst')} AS back
FROM E e JOIN Z z ON z.iy = e.iy % 3 AND z.ix = e.ix % 4""")
def dse_roundtrip(spark, sf_dir):
    z = view_z(spark, sf_dir).withColumnsRenamed({"iy": "zy", "ix": "zx"})
    e = view_e(spark, sf_dir).withColumns({"zy": F.col("iy") % 3, "zx": F.col("ix") % 4})
    dse = reshape.dry_static_energy(280 + F.col("fcst"), F.col("z"))
    df = e.join(z, ["zy", "zx"]).withColumn("dse", dse)
    back = reshape.temperature_of(F.col("dse"), F.col("z"))
    return df.select("t", "iy", "ix", rd("dse", 4).alias("dse"), rd(back).alias("back"))


@query("flip_augment", f"""
SELECT {sts('TIMESTAMP ' + "'2000-01-01'" + ' + to_hours(t) + to_minutes(k)')} AS time, k AS copy,
  CAST(CASE WHEN k IN (1, 3) THEN 7 - iy ELSE iy END AS INT) AS iy,
  CAST(CASE WHEN k IN (2, 3) THEN 7 - ix ELSE ix END AS INT) AS ix, {r('fcst')} AS fcst
FROM E, (SELECT unnest([0, 1, 2, 3]) AS k)""")
def flip_augment(spark, sf_dir):
    start = F.lit("2000-01-01").cast("timestamp_ntz")
    hours = F.make_dt_interval(hours=F.col("t").cast("int"))
    df = reshape.flip_augment(view_e(spark, sf_dir).withColumn("time", start + hours), 8, 8)
    return df.select(ts().alias("time"), "copy", "iy", "ix", rd("fcst").alias("fcst"))


JOINED = "SELECT h.*, z.z FROM H h LEFT JOIN Z z ON z.iy = h.iy AND z.ix = h.ix"


@query("static_flags", f"""
WITH J AS ({JOINED}),
C AS (SELECT iy, ix, max(fcst) = min(fcst) AS f, max(ref_) = min(ref_) AS r, max(z) = min(z) AS zz FROM J GROUP BY ALL)
SELECT 'fcst' AS variable, bool_and(f) AS is_static FROM C UNION ALL SELECT 'ref_', bool_and(r) FROM C
UNION ALL SELECT 'z', bool_and(coalesce(zz, true)) FROM C""")
def static_flags(spark, sf_dir):
    df = reshape.broadcast_static(view_h(spark, sf_dir), view_z(spark, sf_dir))
    return reshape.static_flags(df, ["fcst", "ref_", "z"])


@query("split_static_dynamic", f"""
WITH J AS ({JOINED})
SELECT 'static' AS part, NULL AS time, iy, ix, NULL AS fcst, NULL AS ref_, {r('max(z)')} AS z FROM J GROUP BY iy, ix
UNION ALL SELECT 'dynamic', {sts()}, iy, ix, {r('fcst')}, {r('ref_')}, NULL FROM J""")
def split_static_dynamic(spark, sf_dir):
    df = reshape.broadcast_static(view_h(spark, sf_dir), view_z(spark, sf_dir))
    static, dynamic = reshape.split_static_dynamic(df.select("time", "iy", "ix", "fcst", "ref_", "z"))
    none = F.lit(None).cast("double")
    fixed = static.select(F.lit("static").alias("part"), F.lit(None).cast("string").alias("time"), "iy", "ix",
                          none.alias("fcst"), none.alias("ref_"), rd("z").alias("z"))
    return fixed.unionByName(dynamic.select(F.lit("dynamic").alias("part"), ts().alias("time"), "iy", "ix",
                                            rd("fcst").alias("fcst"), rd("ref_").alias("ref_"), none.alias("z")))


@query("field_tensor", f"""
SELECT t, count(*) AS cells, 2 AS channels, {r('max(fcst) FILTER (WHERE iy = 0 AND ix = 1)')} AS second_in,
  {r('max(ref_) FILTER (WHERE iy = 7 AND ix = 7)')} AS last_tar, {r('sum((8 * iy + ix) * fcst)', 4)} AS weighted
FROM E GROUP BY t""")
def field_tensor(spark, sf_dir):
    df = reshape.field_tensor(view_e(spark, sf_dir), ["fcst"], ["ref_"], 8, 8, time="t")
    tensor = F.col("tensor")
    places = F.transform(tensor, lambda c, i: i * c[0].cast("double"))
    weighted = F.aggregate(places, F.lit(0.0), lambda s, x: s + x)
    return df.select("t", F.size("tensor").cast("bigint").alias("cells"), F.size(tensor[0]).alias("channels"),
                     rd(tensor[1][0].cast("double")).alias("second_in"),
                     rd(tensor[63][1].cast("double")).alias("last_tar"), rd(weighted, 4).alias("weighted"))


@query("vector_targets", f"""
SELECT {sts('d.time')} AS time, d.iy, d.ix, {r('d.t_tar')} AS u, {r('d.t_in')} AS v, {r('z.z')} AS z
FROM D d LEFT JOIN Z z ON z.iy = d.iy AND z.ix = d.ix""")
def vector_targets(spark, sf_dir):
    df = reshape.broadcast_static(view_d(spark, sf_dir), view_z(spark, sf_dir))
    v = reshape.vector_target(df, ["t_tar", "t_in"], "z")
    return v.select(ts().alias("time"), "iy", "ix", rd("target.t_tar").alias("u"), rd("target.t_in").alias("v"),
                    rd("target.z").alias("z"))
