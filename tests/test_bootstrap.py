"""Block bootstrap per key by one product of counts and blocks."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.operators import resample

START = dt.datetime(2020, 1, 1)


@pytest.fixture(scope="module")
def blocks(spark):
    """Blocks of six cells and two values; cells 4 and 5 lack some, and values are missing here and there."""
    rng = np.random.default_rng(7)
    rows = [(c, b, float(rng.normal()), None if (c + b) % 5 == 0 else float(b + 10 * c)) for c in range(6) for b in range(15)
            if not (c == 4 and b % 2) and not (c == 5 and b != 3)]
    return spark.createDataFrame(rows, "cell int, iblock long, v double, w double")


def as_dict(df):
    return {(r.cell, r.iboot): (r.v_bootstrapped, r.w_bootstrapped) for r in df.collect()}


def test_matrix_equals_join(spark, blocks, monkeypatch):
    product = as_dict(resample.block_bootstrap(blocks, ["v", "w"], 40, keys=["cell"]))
    monkeypatch.setattr(resample, "MATRIX_CELLS", 0)
    joined = as_dict(resample.block_bootstrap(blocks, ["v", "w"], 40, keys=["cell"]))
    assert len(product) == 6 * 40
    for key, values in product.items():
        if key in joined:
            assert values == pytest.approx(joined[key], nan_ok=True)
        else:  # no block of this cell was drawn
            assert values == (None, None)


def test_counts_are_the_draws(spark):
    counts = resample.count_matrix(spark, 30, 12, seed=5)
    assert counts.sum(axis=1).tolist() == [12] * 30
    drawn = {}
    for r in resample.bootstrap_draws(spark, 30, 12, 5).collect():
        drawn[r.iboot, r.iblock] = drawn.get((r.iboot, r.iblock), 0) + 1
    assert drawn == {(int(i), int(j)): int(counts[i, j]) for i, j in zip(*np.nonzero(counts))}


@pytest.mark.parametrize("limit", [0, 1 << 25])
def test_intervals_per_cell(spark, blocks, monkeypatch, limit):
    monkeypatch.setattr(resample, "MATRIX_CELLS", limit)
    boots = as_dict(resample.block_bootstrap(blocks, ["v", "w"], 40, keys=["cell"]))
    got = {r.cell: r for r in resample.block_bootstrap_ci(blocks, ["v", "w"], {"lo": 0.1, "hi": 0.9}, 40, keys=["cell"]).collect()}
    assert set(got) == set(range(6))
    for c, r in got.items():
        for i, name in enumerate("vw"):
            x = [values[i] for (cell, _), values in boots.items() if cell == c and values[i] is not None]
            assert (r[f"{name}_lo"], r[f"{name}_hi"]) == pytest.approx(tuple(np.quantile(x, [0.1, 0.9])))


def test_a_cell_without_values(spark):
    blocks = spark.createDataFrame([(0, b, float(b)) for b in range(10)] + [(1, b, None) for b in range(10)], "cell int, iblock long, v double")
    got = {r.cell: r.v_lo for r in resample.block_bootstrap_ci(blocks, ["v"], {"lo": 0.5}, 20, keys=["cell"]).collect()}
    assert got[1] is None and got[0] is not None


def test_a_doubled_step_beside_a_missing_one_is_found(spark):
    for length in (10, 130):
        days = [i for i in range(3 * length) if i != 4] + [7]
        rows = [(START + dt.timedelta(days=i), k, 1.0) for k in (0, 1) for i in (days if k else range(3 * length))]
        df = spark.createDataFrame(rows, "time timestamp_ntz, k int, v double")
        with pytest.raises(Exception, match="more than one row per key"):
            resample.block_means(df, ["v"], length, keys=["k"]).collect()
        assert resample.block_means(df.distinct(), ["v"], length, keys=["k"]).count() == 6


def test_maps_shuffle_their_blocks_only(spark):
    """A map of 93,312 cells and 1,000 replicates: what is shuffled are cells times blocks, whatever the replicates."""
    cells, n = 93_312, 10
    blocks = spark.range(cells * n).select((F.col("id") % cells).alias("cell"), F.floor(F.col("id") / cells).alias("iblock"),
                                           (F.col("id") % 1000).cast("double").alias("v"))
    df = resample.block_bootstrap_ci(blocks, ["v"], {"lo": 0.025, "hi": 0.975}, 1000, keys=["cell"])
    assert df.where("v_lo IS NOT NULL AND v_lo <= v_hi").count() == cells
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
