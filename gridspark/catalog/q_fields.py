"""Gradients, derivatives, detrending and spectra of dense fields."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from gridspark.catalog.fixtures import GRID_E, view_e
from gridspark.catalog.registry import query, r, rd
from gridspark.operators import gradient, spectrum
from gridspark.operators.scores import score

RAD = math.pi / 180
STEP = 6371.0e3 * 0.5 * RAD


def _diff_sql(v: str, coord: str, index: str, line: str) -> str:
    """Central difference inside a line of eight cells, one-sided at its ends."""
    w = f"OVER (PARTITION BY t, {line} ORDER BY {index})"
    up, down, cu, cd = (f"{f}({x}) {w}" for x in (v, coord) for f in ("lead", "lag"))
    return f"""CASE WHEN {index} = 0 THEN ({up} - {v}) / ({cu} - {coord}) WHEN {index} = 7 THEN ({v} - {down}) / ({coord} - {cd})
      ELSE ({up} - {down}) / ({cu} - {cd}) END"""


def _grad_sql(v: str) -> str:
    return f"""sqrt(power(({_diff_sql(v, 'lon', 'ix', 'iy')}) / ({STEP} * cos(radians(lat))), 2)
      + power(({_diff_sql(v, 'lat', 'iy', 'ix')}) / {STEP}, 2))"""


GRADS = f"SELECT t, {_grad_sql('fcst')} AS gf, {_grad_sql('ref_')} AS gr FROM E"


@query("spatial_gradient", f"""
WITH G AS ({GRADS}) SELECT t, {r('avg(gf) * 1e6')} AS grad_fcst, {r('avg(gr) * 1e6')} AS grad_ref FROM G GROUP BY t""")
def spatial_gradient(spark, sf_dir):
    df = gradient.spatial_gradient(view_e(spark, sf_dir), ["fcst", "ref_"], 0.5, 0.5, time="t", grid=GRID_E)
    return df.select("t", rd(F.col("grad_fcst") * 1e6).alias("grad_fcst"), rd(F.col("grad_ref_") * 1e6).alias("grad_ref"))


@query("grad_amplitude_ratio", f"""
WITH G AS ({GRADS}) SELECT t, {r('avg(gf) / nullif(avg(gr), 0)')} AS grad_amplitude FROM G GROUP BY t""")
def grad_amplitude_ratio(spark, sf_dir):
    df = gradient.amplitude_ratio(view_e(spark, sf_dir), ["t"], 0.5, 0.5, time="t", grid=GRID_E)
    return df.select("t", rd("grad_amplitude").alias("grad_amplitude"))


WIDE = """sqrt(power(({x}) / (6371.0e3 * cos(radians(lat)) * radians(0.75)), 2) + power(({y}) / (6371.0e3 * radians(0.5)), 2))"""


def _wide_sql(v: str) -> str:
    # longitudes are stretched by half, so differences along them are smaller by a third
    return WIDE.format(x=f"({_diff_sql(v, 'lon', 'ix', 'iy')}) / 1.5", y=_diff_sql(v, "lat", "iy", "ix"))


@query("grad_amplitude_by_hour", f"""
WITH G AS (SELECT t, {_wide_sql('fcst')} AS gf, {_wide_sql('ref_')} AS gr FROM E),
P AS (SELECT t, avg(gf) / nullif(avg(gr), 0) AS q FROM G GROUP BY t)
SELECT CAST(t % 24 AS BIGINT) AS hour, {r('avg(q)')} AS grad_amplitude FROM P GROUP BY ALL""")
def grad_amplitude_by_hour(spark, sf_dir):
    e = view_e(spark, sf_dir).withColumns({"lon": 1.5 * F.col("lon"), "hour": F.col("t") % 24})
    return score(e, "grad_amplitude", ["hour"], time="t").select("hour", rd("grad_amplitude").alias("grad_amplitude"))


@query("centered_difference", f"""
WITH X AS (SELECT t, iy, ix, fcst AS f, 6.0 + 0.5 * ix + 0.01 * ix * ix AS c FROM E),
N AS (SELECT *, lag(f) OVER w AS f0, lead(f) OVER w AS f2, c - lag(c) OVER w AS h1, lead(c) OVER w - c AS h2 FROM X
  WINDOW w AS (PARTITION BY t, iy ORDER BY ix))
SELECT t, iy, ix, {r('''CASE WHEN ix = 0 THEN (f2 - f) / h2 WHEN ix = 7 THEN (f - f0) / h1
  ELSE (h1 * h1 * f2 + (h2 * h2 - h1 * h1) * f - h2 * h2 * f0) / (h1 * h2 * (h1 + h2)) END''')} AS slope FROM N""")
def centered_difference(spark, sf_dir):
    e = view_e(spark, sf_dir).withColumn("c", 6.0 + 0.5 * F.col("ix") + 0.01 * F.col("ix") * F.col("ix"))
    slope = gradient.centered_difference(F.col("fcst"), F.col("c"), "ix", ["t", "iy"])
    return e.withColumn("slope", slope).select("t", "iy", "ix", rd("slope").alias("slope"))


DEG2M = 6378.0e3 * 2 * math.pi / 360


@query("domain_info", f"""
WITH X AS (SELECT count(DISTINCT ix) AS nx, count(DISTINCT iy) AS ny, min(lon) FILTER (WHERE ix = 1)
  - min(lon) FILTER (WHERE ix = 0) AS dx, min(lat) FILTER (WHERE iy = 1) - min(lat) FILTER (WHERE iy = 0) AS dy,
  avg(lat) AS lat0 FROM E)
SELECT nx, ny, {r('dx')} AS dx, {r('dy')} AS dy, {r('lat0')} AS lat0,
  {r(f'abs(nx * dx * {DEG2M}) * cos(radians(lat0))', 3)} AS lx, {r(f'abs(ny * dy * {DEG2M})', 3)} AS ly FROM X""")
def domain_info(spark, sf_dir):
    df = spectrum.domain_info(view_e(spark, sf_dir))
    return df.select("nx", "ny", *[rd(c).alias(c) for c in ("dx", "dy", "lat0")], rd("lx", 3).alias("lx"),
                     rd("ly", 3).alias("ly"))


def _flat_sql(v: str) -> str:
    """Field without its edge-to-edge change, as the named columns t, iy, ix, v."""
    x = f"(last_value({v}) OVER a - first_value({v}) OVER a) / 7.0"
    return f"""SELECT t, iy, ix, v1 - 0.5 * (last_value(v1) OVER b - first_value(v1) OVER b) / 7.0 * (2 * iy - 8) AS v
  FROM (SELECT t, iy, ix, {v} - 0.5 * {x} * (2 * ix - 8) AS v1 FROM E WINDOW a AS (PARTITION BY t, iy ORDER BY ix
    ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
  WINDOW b AS (PARTITION BY t, ix ORDER BY iy ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""


@query("detrend_field", f"WITH V AS ({_flat_sql('fcst')}) SELECT t, iy, ix, {r('v')} AS detrended FROM V")
def detrend_field(spark, sf_dir):
    df = spectrum.detrend_field(view_e(spark, sf_dir), "fcst", 8, 8, time="t")
    return df.select("t", "iy", "ix", rd("detrended").alias("detrended"))


DKX = 2 * math.pi / (8 * 0.5 * DEG2M * math.cos(49.75 * RAD))
DKY = 2 * math.pi / (8 * 0.5 * DEG2M)


def _spectrum_sql(v: str) -> str:
    """Separable Fourier sums over the flattened field, then the power per ring."""
    return f"""SELECT t, '{v}' AS variable, CAST(round_even(sqrt(power(kx * {DKX}, 2) + power(ky * {DKY}, 2)) / {max(DKX, DKY)}, 0) AS INT) AS k,
    sum(power(re / 64, 2) + power(im / 64, 2)) AS power FROM (
    SELECT t, kx, ky, sum(re * cos(a) + im * sin(a)) AS re, sum(im * cos(a) - re * sin(a)) AS im FROM (
      SELECT t, kx, iy, ky, re, im, 2 * pi() * ky * iy / 8 AS a FROM (
        SELECT t, iy, kx, sum(v * cos(2 * pi() * kx * ix / 8)) AS re, -sum(v * sin(2 * pi() * kx * ix / 8)) AS im
        FROM ({_flat_sql(v)}), range(8) q(kx) GROUP BY ALL), range(8) p(ky)) GROUP BY ALL) GROUP BY ALL"""


SPECTRA = f"SELECT * FROM (({_spectrum_sql('fcst')}) UNION ALL ({_spectrum_sql('ref_')})) WHERE k < 4"


@query("power_spectrum", f"SELECT t, variable, k, {r('power', 10)} AS power FROM ({SPECTRA})")
def power_spectrum(spark, sf_dir):
    df = spectrum.power_spectrum(view_e(spark, sf_dir), ["fcst", "ref_"], GRID_E, time="t")
    return df.select("t", "variable", "k", rd("power", 10).alias("power"))


@query("mean_spectrum", f"SELECT variable, k, {r('avg(power)', 10)} AS power FROM ({SPECTRA}) GROUP BY variable, k")
def mean_spectrum(spark, sf_dir):
    df = spectrum.mean_spectrum(spectrum.power_spectrum(view_e(spark, sf_dir), ["fcst", "ref_"], GRID_E, time="t"))
    return df.select("variable", "k", rd("power", 10).alias("power"))
