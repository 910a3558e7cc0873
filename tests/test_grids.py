from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.operators import grid as g
from gridspark.operators import regrid, reshape, vertical
from gridspark.operators.grid import Grid
from gridspark.plans.prepare import coarsen_then_refine
from gridspark.sources import griddes

FINE = Grid(8, 6, 6.0, 0.5, 48.0, 0.5)


def area(grid):
    lat = grid.y0 + grid.dy * np.arange(grid.ny)
    band = np.sin(np.radians(lat + abs(grid.dy) / 2)) - np.sin(np.radians(lat - abs(grid.dy) / 2))
    return np.repeat(band[:, None], grid.nx, 1)


def flipped(grid):
    """The same cells with latitude from north to south."""
    return Grid(grid.nx, grid.ny, grid.x0, grid.dx, grid.y0 + (grid.ny - 1) * grid.dy, -grid.dy)


@pytest.mark.parametrize("target", [FINE.coarsened(2), flipped(FINE.coarsened(2)), Grid(3, 3, 6.4166666667, 1.3333333333, 48.25, 1.0)])
def test_conservative_keeps_the_area_mean(make_fields, to_array, target):
    v = np.random.default_rng(3).normal(size=(2, 6, 8))
    out = to_array(regrid.remap_conservative(make_fields(v=v), FINE, target, ["v"]), "v")
    for t in range(2):
        assert np.average(out[t], weights=area(target)) == pytest.approx(np.average(v[t], weights=area(FINE)), abs=1e-9)


def test_conservative_leaves_missing_cells_out(make_fields, to_array):
    v = np.ones((1, 6, 8))
    v[0, 0, 0] = np.nan
    v[0, 2:4, 2:4] = np.nan
    out = to_array(regrid.remap_conservative(make_fields(v=v), FINE, FINE.coarsened(2), ["v"]), "v")
    assert out[0, 0, 0] == pytest.approx(1.0)
    assert np.isnan(out[0, 1, 1])


def test_bilinear_is_exact_on_a_plane_also_outside(make_fields, to_array):
    lat, lon = 48 + 0.5 * np.arange(6)[:, None], 6 + 0.5 * np.arange(8)[None, :]
    plane = (2 * lon - 3 * lat + 1)[None]
    target = Grid(5, 4, 5.5, 1.1, 51.0, -0.9)
    out = to_array(regrid.remap_bilinear(make_fields(v=plane), FINE, target, ["v"]), "v")[0]
    t_lat, t_lon = 51.0 - 0.9 * np.arange(4)[:, None], 5.5 + 1.1 * np.arange(5)[None, :]
    np.testing.assert_allclose(out, 2 * t_lon - 3 * t_lat + 1, atol=1e-9)
    kept = to_array(regrid.remap_bilinear(make_fields(v=plane), FINE, target, ["v"], extrapolate=False), "v")[0]
    inside = 2 * np.clip(t_lon, 6, 9.5) - 3 * np.clip(t_lat, 48, 50.5) + 1
    np.testing.assert_allclose(kept, inside, atol=1e-9)


def test_bilinear_missing_neighbour_is_missing(make_fields, to_array):
    v = np.ones((1, 6, 8))
    v[0, 3, 3] = np.nan
    out = to_array(regrid.remap_bilinear(make_fields(v=v), FINE, Grid(7, 5, 6.25, 0.5, 48.25, 0.5), ["v"]), "v")[0]
    assert np.isnan(out[2:4, 2:4]).all() and np.isnan(out).sum() == 4


def test_weights_of_a_target_cell_add_up(spark):
    w = regrid.bilinear_weights(spark, FINE, Grid(7, 5, 5.9, 0.6, 47.0, 0.7)).groupBy("ty", "tx").agg(F.sum("w").alias("s"))
    assert all(r.s == pytest.approx(1.0) for r in w.collect())
    around = Grid(12, 4, 0.0, 30.0, 45.0, 2.0)
    for weights in (regrid.bilinear_weights, regrid.conservative_weights):
        w = weights(spark, around, Grid(4, 3, -40.0, 20.0, 46.0, 1.5)).groupBy("ty", "tx").agg(F.sum("w").alias("s"), F.min("ix").alias("lo"))
        assert w.count() == 12 and all(r.lo >= 0 for r in w.collect())


def test_targets_without_source_are_missing(make_fields, to_array):
    out = to_array(regrid.remap_conservative(make_fields(v=np.ones((2, 6, 8))), FINE, Grid(40, 3, FINE.x0, FINE.dx, FINE.y0, FINE.dy), ["v"]), "v")
    assert out.shape == (2, 3, 40) and (out[:, :, :8] == 1).all() and np.isnan(out[:, :, 8:]).all()


def test_pipeline_keeps_the_height_dependence(spark, make_fields, to_array):
    # a field whose dry static energy is constant comes back unchanged whatever the topography
    z = np.random.default_rng(4).uniform(0, 5000, size=(1, 8, 8))
    t = (300000 - z - reshape.GRAVITY * 2) / reshape.CPD
    grid = Grid(8, 8, 6.0, 0.5, 48.0, 0.5)
    static = make_fields(z=z).drop("time")
    out = coarsen_then_refine(make_fields(temp=t), grid, 2, ["temp"], "temp", static)
    assert set(out.columns) == {"time", "iy", "ix", "temp_in", "z_in", "temp_tar"}
    t_in, z_in = to_array(out, "temp_in"), to_array(out, "z_in")
    np.testing.assert_allclose(t_in * reshape.CPD + z_in + reshape.GRAVITY * 2, 300000, atol=1e-5)


def test_vertical_is_exact_in_the_logarithm_of_pressure(spark):
    levels = [100000.0, 50000.0, 85000.0, 70000.0]
    rows = [(t, 0, 0, p, 2 * np.log(p) + t) for t in (0, 1) for p in levels]
    df = spark.createDataFrame([tuple(map(float, r[3:])) + r[:3] for r in rows],
                               "p double, v double, time int, iy int, ix int")
    targets = [30000, 50000, 60000, 85000, 99000, 110000]
    out = vertical.to_pressure_levels(df, targets, ["v"]).collect()
    assert len(out) == 2 * len(targets)
    assert all(r.v == pytest.approx(2 * np.log(r.plev) + r.time, abs=1e-9) for r in out)


def test_coarsened_and_padded_grids():
    fine = Grid(128, 96, 3.0, 0.25, 40.0, 0.25)
    assert fine.coarsened(4) == Grid(32, 24, 3.375, 1.0, 40.375, 1.0)
    base, coarse = fine.padded(4)
    assert base == Grid(136, 104, 2.0, 0.25, 39.0, 0.25)
    assert coarse == Grid(34, 26, 3.0 - 2.5 * 0.25, 1.0, 40.0 - 2.5 * 0.25, 1.0)
    with pytest.raises(ValueError):
        fine.coarsened(5)
    assert Grid(4, 3, 7.0, 0.5, 50.0, -0.5).box() == (7.0, 8.75, 48.75, 50.0)


def test_cells_and_table_of_grids(spark):
    cells = g.grid_cells(spark, Grid(3, 2, 1.0, 0.5, 10.0, -1.0)).collect()
    assert len(cells) == 6
    last = [c for c in cells if (c.iy, c.ix) == (1, 2)][0]
    assert (last.lat, last.lon, last.lat_lo, last.lat_hi, last.lon_lo, last.lon_hi) == (9.0, 2.0, 8.5, 9.5, 1.75, 2.25)
    with pytest.raises(Exception, match="divisible"):
        g.coarsen_table(g.grid_row(spark, Grid(7, 4, 0.0, 1.0, 0.0, 1.0)), 2).collect()
    row = g.coarsen_table(g.grid_row(spark, Grid(8, 4, 0.0, 1.0, 0.0, 1.0)), 2, extrapolate=True).first()
    assert (row.coarse_xsize, row.coarse_ysize, row.coarse_xfirst) == (4, 2, 0.5)


def test_grid_text(spark, tmp_path):
    path = tmp_path / "grid.txt"
    path.write_text("#\n gridtype = lonlat\nxsize=128\nysize = 96\nxfirst = 3.5\nxinc = 0.25\n"
                    "yfirst = 40\nyinc = -0.25\nnote = a = b\n")
    assert griddes.read_grid(spark, str(path)) == Grid(128, 96, 3.5, 0.25, 40.0, -0.25)
    grids = griddes.parse_grids(spark.read.text(str(path)).withColumn("name", F.lit("a")), keys=["name"])
    griddes.write_grids(grids, str(tmp_path / "out"), "name")
    assert griddes.read_grid(spark, str(tmp_path / "out" / "name=a")) == Grid(128, 96, 3.5, 0.25, 40.0, -0.25)
    bad = spark.createDataFrame([("xsize = 1",), ("colour = blue",)], "value string")
    with pytest.raises(Exception, match="colour"):
        griddes.parse_grids(bad).collect()
    assert griddes.parse_grids(bad, strict=False).first().invalid_keys == ["colour"]
