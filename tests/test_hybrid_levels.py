"""Hybrid model levels on pressure levels against NumPy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.operators import vertical

N = 21
B = np.linspace(0, 1, N + 1) ** 2
A = 30000 * np.linspace(0, 1, N + 1) * (1 - np.linspace(0, 1, N + 1))


@pytest.fixture(scope="module")
def half(spark):
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(A, B))], "half int, a double, b double")


def pressures(sp):
    h = A + B * sp
    return (h[1:] + h[:-1]) / 2


def interpolated(p, v, target):
    i = min(max(int((p < target).sum()), 1), len(p) - 1)
    return v[i - 1] + (v[i] - v[i - 1]) * np.log(target / p[i - 1]) / np.log(p[i] / p[i - 1])


def fields(spark, rows):
    return spark.createDataFrame(rows, "time long, iy int, ix int, level int, t double, q double")


def surface(spark, rows):
    return spark.createDataFrame(rows, "time long, iy int, ix int, sp double")


def test_against_numpy_inside_and_outside(spark, half):
    rng = np.random.default_rng(2)
    v, sp = rng.normal(size=(3, 4, N, 2)), 95000 + 9000 * rng.random((3, 4))
    rows = [(t, 0, x, k + 1, *map(float, v[t, x, k])) for t in range(3) for x in range(4) for k in range(N)]
    rng.shuffle(rows)
    rows = [(int(a), int(b), int(c), int(d), float(e), float(f)) for a, b, c, d, e, f in rows]
    targets = [10.0, 5000.0, 50000.0, float(pressures(sp[0, 0])[7]), 99000.0, 120000.0]
    got = vertical.hybrid_to_pressure_levels(fields(spark, rows), surface(spark, [
        (t, 0, x, float(sp[t, x])) for t in range(3) for x in range(4)]), half, targets, ["t", "q"]).collect()
    assert len(got) == 3 * 4 * len(targets)
    for r in got:
        p = pressures(sp[r.time, r.ix])
        for i, name in enumerate(("t", "q")):
            assert r[name] == pytest.approx(interpolated(p, v[r.time, r.ix, :, i], r.plev), rel=1e-9, abs=1e-9)


def test_search_by_halving(spark):
    for n in (1, 2, 3, 7, 8, 137, 1000):
        values = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda x: F.struct((x * 2.0).alias("p"))).alias("v"))
        for bound, want in ((0.0, 0), (2.0, 0), (2.5, 1), (2.0 * n, n - 1), (2.0 * n + 1, n)):
            assert values.select(vertical._below(F.col("v"), F.lit(bound))).first()[0] == want


def test_missing_parts(spark, half):
    rows = [(0, 0, 0, k, float(k), None if k == 2 else 1.0) for k in (1, 2, 3)]
    rows += [(1, 0, 0, 1, 1.0, 1.0)] + [(2, 0, 0, k, 1.0, 1.0) for k in (1, 2)] + [(3, 0, 0, k, 1.0, 1.0) for k in (1, 2)]
    rows += [(4, 0, 0, k, float(k), 1.0) for k in (1, 2, 99)] + [(5, 0, 0, None, 1.0, 1.0)]
    sp = [(0, 0, 0, 1e5), (1, 0, 0, 1e5), (2, 0, 0, None), (4, 0, 0, 1e5), (5, 0, 0, 1e5)]
    got = {r.time: r for r in vertical.hybrid_to_pressure_levels(fields(spark, rows), surface(spark, sp), half, [1000.0], ["t", "q"]).collect()}
    assert set(got) == {0, 4}  # one level, no surface pressure, no surface row, no level
    assert got[0].q is None and got[0].t is not None


def test_errors(spark, half):
    rows = [(0, 0, 0, 1, 1.0, 1.0), (0, 0, 0, 2, 1.0, 1.0)]
    one = surface(spark, [(0, 0, 0, 1e5)])
    with pytest.raises(Exception, match="a level more than once"):
        vertical.hybrid_to_pressure_levels(fields(spark, [*rows, (0, 0, 0, 2, 5.0, 1.0)]), one, half, [1e4], ["t"]).collect()
    with pytest.raises(Exception, match="more than one surface pressure"):
        vertical.hybrid_to_pressure_levels(fields(spark, rows), one.unionAll(one), half, [1e4], ["t"]).collect()
    with pytest.raises(Exception, match="without gaps"):
        vertical.hybrid_to_pressure_levels(fields(spark, rows), one, half.where("half != 3"), [1e4], ["t"]).collect()


def test_no_window_and_one_placement(spark, half):
    df = vertical.hybrid_to_pressure_levels(fields(spark, [(0, 0, 0, 1, 1.0, 1.0)]), surface(spark, [(0, 0, 0, 1e5)]), half, [1e4], ["t"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
