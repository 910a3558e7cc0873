"""The physical plans that matter at scale."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.operators import align, distribution, gradient, regrid, resample, select, spectrum
from gridspark.operators.grid import Grid
from gridspark.session import scratch_dir, stored
from gridspark.sources import tables

GRID = Grid(8, 8, 6.0, 0.5, 48.0, 0.5)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def fields(spark, make_fields):
    """A stored grid table, large enough in Spark's eyes not to be broadcast itself."""
    v = np.random.default_rng(8).gamma(1, 3, size=(2, 20, 8, 8))
    return stored(make_fields(GRID, fcst=v[0], ref_=v[1]), "fields")


def test_box_and_columns_reach_the_scan(fields):
    text = plan(select.sel_lonlat_box(fields, (7.0, 8.0, 49.0, 50.0)).select("time", "fcst"))
    assert "GreaterThanOrEqual(lon,7.0)" in text and "LessThanOrEqual(lat,50.0)" in text
    schema = text.split("ReadSchema: ")[1].splitlines()[0]
    assert "fcst" in schema and "ref_" not in schema and "iy" not in schema


def test_only_chosen_columns_are_read(spark, fields):
    path = scratch_dir(spark, "p")
    tables.write_compressed(fields, path)
    text = plan(tables.scan_multifile(spark, [path], ["time", "ref_"]))
    assert "ReadSchema: struct<time:bigint,ref_:double>" in text


def test_regridding_is_a_broadcast_equi_join(fields):
    text = plan(regrid.remap_conservative(fields, GRID, GRID.coarsened(2), ["fcst"]))
    assert "BroadcastHashJoin [iy" in text and "Cartesian" not in text and "NestedLoop" not in text
    assert text.count("Exchange hashpartitioning") == 1


def test_gradient_takes_one_shuffle(fields):
    text = plan(gradient.spatial_gradient(fields, ["fcst", "ref_"], 0.5, 0.5, grid=GRID))
    assert text.count("Exchange hashpartitioning") == 1
    without = plan(gradient.spatial_gradient(fields, ["fcst", "ref_"], 0.5, 0.5))
    assert without.count("Exchange hashpartitioning") == 3


def test_spectrum_takes_one_shuffle(fields):
    assert plan(spectrum.power_spectrum(fields, ["fcst"], GRID)).count("Exchange hashpartitioning") == 1


def test_anomalies_do_not_shuffle_the_data(fields):
    text = plan(align.anomalies(fields, align.climatology(fields, "ref_"), ["fcst"]))
    assert "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in text


def test_permutation_does_not_shuffle_the_data(fields):
    text = plan(resample.sample_permut_xyt(fields.select("time", "iy", "ix", "fcst"), 8, 8, (2, 2)))
    assert text.count("BroadcastHashJoin") == 2 and "Exchange hashpartitioning" not in text


def test_distribution_needs_no_sort(fields):
    assert " Sort [" not in plan(distribution.iqd(fields))


def test_listing_reads_no_content(spark, fields):
    path = scratch_dir(spark, "f")
    fields.repartition(3).write.parquet(path)
    files = tables.list_files(spark, path)
    assert files.count() == 3 and "content" not in plan(files).split("ReadSchema")[1]
    assert select.natural_order(files.withColumnRenamed("path", "fname")).agg(F.max("pos")).first()[0] == 3
    with pytest.raises(FileNotFoundError):
        tables.list_files(spark, path, "*.nc")


def test_quantiles_sort_only_what_two_broadcasts_let_through(fields, monkeypatch):
    from gridspark.functions import quantiles
    from gridspark.functions.quantiles import grouped_quantiles

    monkeypatch.setattr(quantiles, "BIG", 10)

    text = plan(grouped_quantiles(fields.withColumn("k", F.col("ix") % 3), ["k"], "fcst", [0.5]))
    before_first_shuffle = text.split("Exchange hashpartitioning")[-1]
    assert "BroadcastHashJoin [k" in before_first_shuffle and "SortMergeJoin" not in text


def test_coarse_and_fine_fields_are_placed_once(spark, make_fields):
    import numpy as np

    from gridspark.operators.grid import Grid
    from gridspark.plans.prepare import coarsen_then_refine
    from gridspark.session import stored

    grid = Grid(8, 6, 5.0, 0.5, 48.0, 0.5)
    rng = np.random.default_rng(0)
    # stored, so that Spark knows that the static side is small
    df = stored(make_fields(grid, temp=rng.normal(280, 3, (5, 6, 8)), wind=rng.normal(size=(5, 6, 8))), "fields")
    static = df.where("time = 0").selectExpr("iy", "ix", "wind * 100 AS z")
    out = coarsen_then_refine(df, grid, 2, ["temp", "wind"], "temp", static)
    assert out.count() == 5 * 48
    out.collect()
    final = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    # the fields are shuffled by time once, everything else is broadcast
    assert final.count("- Exchange hashpartitioning") == final.count("ReusedExchange") == 1 and "SortMergeJoin" not in final


def test_gradients_without_a_grid_are_placed_once(make_fields):
    import numpy as np

    from gridspark.operators import gradient
    from gridspark.operators.grid import Grid

    df = make_fields(Grid(5, 4, 5.0, 0.5, 48.0, 0.5), fcst=np.random.default_rng(0).normal(size=(3, 4, 5)), ref_=np.ones((3, 4, 5)).cumsum(axis=2))
    out = gradient.amplitude_ratio(df)
    assert plan(out).count("Exchange hashpartitioning") == 1
    spread = gradient.spatial_gradient(df, ["fcst"], 0.5, 0.5, together=False)
    assert plan(spread).count("Exchange hashpartitioning") == 3
    whole = gradient.spatial_gradient(df, ["fcst"], 0.5, 0.5, together=True)
    a, b = ({r.time: r.grad_fcst for r in x.collect()} for x in (spread, whole))
    assert a == pytest.approx(b)
    grid = gradient.grid_of(df)
    assert (grid.nx, grid.ny, grid.dx, grid.dy) == (5, 4, 0.5, 0.5) and gradient.grid_of(df.limit(0)) is None


def test_tasks_of_coarse_and_fine_fields_follow_the_cells(spark, make_fields, monkeypatch):
    import numpy as np

    from gridspark.operators.grid import Grid
    from gridspark.plans import prepare
    from gridspark.session import stored

    grid = Grid(8, 6, 5.0, 0.5, 48.0, 0.5)
    df = stored(make_fields(grid, temp=np.random.default_rng(0).normal(280, 3, (20, 6, 8))), "fields")
    static = df.where("time = 0").selectExpr("iy", "ix", "temp * 100 AS z")
    # 20 x 48 cells with two values each
    monkeypatch.setattr(prepare, "PLACED_VALUES", 96)
    out = prepare.coarsen_then_refine(df, grid, 2, ["temp"], "temp", static)
    assert len(out.collect()) == 20 * 48
    assert re.search(r"hashpartitioning\(time#\w+, 20\), REPARTITION_BY_NUM", plan(out))
