"""Rotated poles: coordinates, cells, and weights between grids whose axes do not align."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.functions.sphere import one_turn, to_geographic, to_rotated
from gridspark.operators import clipping, grid, regrid
from gridspark.operators.grid import Grid
from gridspark.sources import griddes

POLE = (39.25, -162.0)
# a part of a rotated model grid, and the regular cells around it
ROTATED = Grid(12, 10, -8.273, 0.55, -3.933, 0.55, pole=POLE)
REGULAR = Grid(44, 36, 0.25, 0.5, 40.25, 0.5)


def area(g: Grid) -> np.ndarray:
    cells = clipping.corners(g, np.arange(g.nx * g.ny))
    return clipping.common_areas(cells, cells)[1]


def collected(weights):
    return [(r.iy, r.ix, r.ty, r.tx, r.w) for r in weights.collect()]


def test_rotation_and_back(spark):
    points = [(y, x) for y in (-89.9, -45.0, 0.0, 12.5, 60.0, 89.5) for x in (-179.0, -90.0, 0.0, 18.0, 133.3)]
    df = spark.createDataFrame(points, "lat double, lon double")
    pole = [F.lit(p) for p in POLE]
    there = df.select("lat", "lon", *[c.alias(n) for n, c in zip(("y", "x"), to_rotated(F.col("lat"), F.col("lon"), *pole))])
    back = there.select("lat", "lon", *[c.alias(n) for n, c in zip(("y", "x"), to_geographic(F.col("y"), F.col("x"), *pole))])
    for r in back.collect():
        assert abs(r.y - r.lat) < 1e-9 and abs(math.remainder(r.x - r.lon, 360)) * math.cos(math.radians(r.lat)) < 1e-9


def test_known_places(spark):
    # the origin of the rotated system lies on the meridian opposite to its pole
    pole = [F.lit(p) for p in POLE]
    one = spark.range(1)
    lat, lon = one.select(*to_geographic(F.lit(0.0), F.lit(0.0), *pole)).first()
    assert (lat, lon) == pytest.approx((50.75, 18.0))
    lat, lon = one.select(*to_geographic(F.lit(90.0), F.lit(0.0), *pole)).first()
    assert (lat, lon) == pytest.approx((39.25, -162.0))
    assert one.select(one_turn(F.lit(540.0 + 30))).first()[0] == pytest.approx(-150.0)


def test_cells_of_a_rotated_grid(spark):
    cells = {(r.iy, r.ix): r for r in grid.grid_cells(spark, ROTATED).collect()}
    assert len(cells) == 120 and cells[0, 0].lat == pytest.approx(-3.933) and cells[0, 0].lon_hi == pytest.approx(-8.273 + 0.275)
    middle = clipping.to_space(ROTATED, np.array([-8.273 + 3 * 0.55]), np.array([-3.933 + 4 * 0.55]))[0]
    c = cells[4, 3]
    assert math.sin(math.radians(c.geo_lat)) == pytest.approx(middle[2])
    assert math.degrees(math.atan2(middle[1], middle[0])) == pytest.approx(c.geo_lon)
    plain = grid.grid_cells(spark, REGULAR).columns
    assert "geo_lat" not in plain


def test_coarse_grids_keep_the_pole():
    assert ROTATED.coarsened(2).pole == POLE and all(g.pole == POLE for g in ROTATED.padded(2))


def test_area_is_kept(spark):
    # regular cells inside the rotated grid are fully covered, and so are rotated cells inside the regular grid
    for src, dst in ((REGULAR, ROTATED), (ROTATED, Grid(12, 6, 7.25, 0.25, 47.75, 0.25)), (REGULAR, ROTATED.coarsened(2))):
        weights = collected(regrid.conservative_weights(spark, src, dst))
        total = np.zeros(dst.nx * dst.ny)
        for _, _, ty, tx, w in weights:
            total[ty * dst.nx + tx] += w
        assert np.abs(total / area(dst) - 1).max() < 1e-9
        assert len({x[:4] for x in weights}) == len(weights)


def test_area_mean_of_a_field_is_kept(spark):
    weights = collected(regrid.conservative_weights(spark, REGULAR, ROTATED))
    rng = np.random.default_rng(1)
    field = rng.normal(size=(REGULAR.ny, REGULAR.nx)) + 280
    out, total, share = np.zeros((ROTATED.ny, ROTATED.nx)), np.zeros((ROTATED.ny, ROTATED.nx)), np.zeros((REGULAR.ny, REGULAR.nx))
    for iy, ix, ty, tx, w in weights:
        out[ty, tx] += w * field[iy, ix]
        total[ty, tx] += w
        share[iy, ix] += w
    fine = (out / total * area(ROTATED).reshape(out.shape)).sum() / area(ROTATED).sum()
    assert fine == pytest.approx((field * share).sum() / share.sum(), rel=1e-9)


def test_weights_against_sampling(spark):
    src, dst = Grid(6, 5, 6.0, 0.7, 48.0, 0.6), Grid(3, 3, -7.0, 0.8, -2.0, 0.9, pole=POLE)
    got = {x[:4]: x[4] for x in collected(regrid.conservative_weights(spark, src, dst))}
    n = 200
    k = (np.arange(n) + 0.5) / n - 0.5
    for cell in range(9):
        ty, tx = divmod(cell, 3)
        x, y = np.meshgrid(dst.x0 + (tx + k) * dst.dx, dst.y0 + (ty + k) * dst.dy)
        p = clipping.to_space(dst, x, y)
        lon, lat = np.degrees(np.arctan2(p[..., 1], p[..., 0])), np.degrees(np.arcsin(p[..., 2]))
        ix, iy = np.floor((lon - src.x0) / src.dx + 0.5).astype(int), np.floor((lat - src.y0) / src.dy + 0.5).astype(int)
        size = np.cos(np.radians(y)) * math.radians(dst.dx) * math.radians(dst.dy) / n**2
        for j in range(src.ny):
            for i in range(src.nx):
                assert got.get((j, i, ty, tx), 0.0) == pytest.approx(size[(ix == i) & (iy == j)].sum(), abs=2e-6 * 0.8)


def test_poles_date_line_and_negative_steps(spark):
    # a cap around the north pole in rotated cells, and the globe in regular ones from north to south
    cap = Grid(8, 8, -14.0, 4.0, -14.0, 4.0, pole=(0.0, 180.0))
    globe = Grid(36, 18, -175.0, 10.0, 85.0, -10.0)
    for src, dst in ((globe, cap), (globe, Grid(6, 6, -2.5, 1.0, -2.5, 1.0, pole=(10.0, 0.0)))):
        weights = collected(regrid.conservative_weights(spark, src, dst))
        assert sum(x[4] for x in weights) == pytest.approx(area(dst).sum(), rel=1e-9)


def test_targets_beyond_the_source_are_missing(spark, make_fields):
    src = Grid(4, 4, 8.0, 0.5, 49.0, 0.5)
    df = make_fields(src, v=np.arange(32, dtype=float).reshape(2, 4, 4))
    got = {(r.time, r.iy, r.ix): r.v for r in regrid.remap_conservative(df, src, ROTATED, ["v"]).collect()}
    assert len(got) == 2 * 120 and any(v is None for v in got.values()) and any(v is not None for v in got.values())
    assert all(-1e-9 <= v <= 31 + 1e-9 for v in got.values() if v is not None)


def test_bilinear_is_exact_for_planes_in_the_coordinates_of_the_source(spark, make_fields):
    y, x = np.meshgrid(np.arange(ROTATED.ny), np.arange(ROTATED.nx), indexing="ij")
    plane = 2.0 * (ROTATED.x0 + x * ROTATED.dx) - 3.0 * (ROTATED.y0 + y * ROTATED.dy) + 1
    dst = Grid(6, 5, 7.5, 0.3, 48.5, 0.3)
    got = regrid.remap_bilinear(make_fields(ROTATED, v=plane[None]), ROTATED, dst, ["v"])
    cells = grid.grid_cells(spark, dst).select("iy", "ix", *[c.alias(n) for n, c in zip(
        ("ry", "rx"), to_rotated(F.col("lat"), F.col("lon"), *(F.lit(p) for p in POLE)))])
    rows = got.join(cells, ["iy", "ix"]).collect()
    assert len(rows) == 30
    for r in rows:
        assert r.v == pytest.approx(2 * r.rx - 3 * r.ry + 1, abs=1e-9)


def test_the_same_pole_needs_no_rotation(spark):
    other = Grid(12, 10, -8.273, 0.55, -3.933, 0.55)
    fine, plain = ROTATED, other
    a = collected(regrid.conservative_weights(spark, fine, fine.coarsened(2)))
    b = collected(regrid.conservative_weights(spark, plain, plain.coarsened(2)))
    assert a == b


def test_too_wide_cells_are_an_error(spark):
    with pytest.raises(ValueError, match="too wide"):
        clipping.clipped_weights(spark, Grid(4, 2, 0.0, 90.0, -45.0, 90.0), ROTATED)


def test_the_join_finds_each_pair_once_by_cubes(spark):
    plan = clipping.clipped_weights(spark, REGULAR, ROTATED)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


DESCRIPTION = """#
# a rotated grid
#
gridtype  = projection
gridsize  = 120
xsize     = 12
ysize     = 10
xname     = rlon
xlongname = "longitude in rotated grid"
xfirst    = -8.273
xinc      = 0.0625
yfirst    = -3.933
yinc      = 0.055
grid_mapping = rotated_pole
grid_mapping_name = rotated_latitude_longitude
grid_north_pole_latitude = 39.25
grid_north_pole_longitude = -162.
"""


def described(spark, text, **kw):
    return griddes.parse_texts(spark.createDataFrame([(1, text)], "id int, value string"), **kw)


def test_all_entries_in_order(spark):
    row = described(spark, DESCRIPTION).withColumn("keys", F.map_keys("entries")).first()
    assert row["keys"][:4] == ["gridtype", "gridsize", "xsize", "ysize"] and len(row.entries) == 14 and row.invalid_keys == []
    assert row.entries["xlongname"] == '"longitude in rotated grid"'
    twice = described(spark, "xsize = 3\nysize = 4\r\nxsize = 5\na = b = c\nno entry\n\n").first()
    assert twice.entries == {"xsize": "5", "ysize": "4"}
    assert described(spark, None).first().entries == {}


def test_keys_that_are_not_allowed(spark):
    assert described(spark, "colour = blue\nxsize = 3", strict=False).first().invalid_keys == ["colour"]
    with pytest.raises(Exception, match="not valid in a grid description: colour"):
        described(spark, "colour = blue").collect()


def test_coarse_and_padded_descriptions(spark):
    row = griddes.with_coarse(described(spark, DESCRIPTION), 2).withColumns(
        {f"{c}_keys": F.map_keys(c) for c in ("entries", "coarse", "base")}).first()
    assert row.coarse_keys == row.base_keys == row.entries_keys
    changed = {k for k in row.entries if row.coarse[k] != row.entries[k]}
    assert changed == {"gridsize", "xsize", "ysize", "xfirst", "xinc", "yfirst", "yinc"}
    assert (row.coarse["gridsize"], row.base["gridsize"]) == (str(8 * 7), str(16 * 14))
    assert float(row.coarse["xfirst"]) == pytest.approx(-8.273 - 1.5 * 0.0625) and float(row.base["yfirst"]) == pytest.approx(-3.933 - 0.11)
    one = griddes.with_coarse(described(spark, DESCRIPTION), 2, extrapolate=True, digits=3).first()
    assert "base" not in one and one.coarse["xsize"] == "6" and float(one.coarse["xinc"]) == pytest.approx(0.124)
    small = griddes.with_coarse(described(spark, DESCRIPTION.replace("gridsize  = 120\n", "")), 2).first()
    assert "gridsize" not in small.coarse


def test_sizes_that_do_not_divide_and_missing_keys(spark):
    with pytest.raises(Exception, match="divisible by 3"):
        griddes.with_coarse(described(spark, DESCRIPTION), 3).collect()
    with pytest.raises(Exception, match="keys missing in a grid description: gridtype, xinc"):
        griddes.with_coarse(described(spark, "xsize=4\nysize=4\nxfirst=0\nyfirst=0\nyinc=1"), 2).collect()


def test_round_trip_through_files(spark, tmp_path):
    rows = griddes.with_coarse(described(spark, DESCRIPTION), 2)
    griddes.write_descriptions(rows, str(tmp_path / "coarse"), "id", "coarse")
    read = griddes.read_grid(spark, str(tmp_path / "coarse" / "id=1"))
    assert read.pole == POLE and (read.nx, read.ny, read.dx) == (8, 7, 0.125)
    plain = tmp_path / "plain"
    plain.write_text("gridtype = lonlat\nxsize = 4\nysize = 3\nxfirst = 1.\nxinc = .5\nyfirst = 2\nyinc = -0.5 \n")
    assert griddes.read_grid(spark, str(plain)) == Grid(4, 3, 1.0, 0.5, 2.0, -0.5)


def test_descriptions_are_shared_by_all_tasks(spark, tmp_path):
    """One small file, as the table is, must not end in one task."""
    from gridspark.catalog import load_queries

    spark.range(300).selectExpr("id AS p_partkey", "CAST(1 + id % 50 AS INT) AS p_size").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    out = load_queries()["griddes_complete"].build(spark, str(tmp_path))
    assert out.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert out.count() == 300 * 45 and out.groupBy("p_partkey").count().where("count != 45").isEmpty()


def test_tasks_follow_the_rows(spark):
    from gridspark.session import tasks_for

    assert tasks_for(spark.range(1000), 10) == 100
    assert tasks_for(spark.range(0), 10) == tasks_for(spark.range(5), 10) == spark.sparkContext.defaultParallelism


def test_numbers_of_texts_are_those_of_a_cast(spark):
    from gridspark.columns import number_of

    texts = [None, "", " ", "rlon", "lonlat", "-162.", " 4 ", "1e3", "1d", "x1", "NaN", "-Infinity", "+inf", "INF", "infinite", "nano", "0x1p3", ".", "-", "٣"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", number_of(F.col("t")).alias("a"), F.col("t").try_cast("double").alias("b")).collect()
    assert all(r.a == r.b or str(r.a) == str(r.b) for r in rows)


def test_a_key_that_comes_twice_takes_the_last_value(spark):
    got = described(spark, "xsize = 4\nysize = 3\nxsize = 8\n").select(griddes.description_text(F.col("entries")).alias("text")).first()
    assert got.text == "xsize = 8\nysize = 3\n"
