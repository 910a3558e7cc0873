from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.operators import distribution, evaluate, gradient, normalize, scores, seeps, spectrum
from gridspark.operators.grid import Grid

GRID = Grid(8, 8, 6.0, 0.5, 48.0, 0.5)
RNG = np.random.default_rng(5)


def value(df, name):
    return df.first()[name]


def test_perfect_forecast(make_fields):
    v = RNG.gamma(1, 2, size=(3, 4, 4))
    df = make_fields(fcst=v, ref_=v)
    assert value(scores.score(df, "bias"), "bias") == 0
    for name in ("ets", "pss", "fbi"):
        assert value(scores.score(df, name, thresh=1.0), name) == pytest.approx(1.0)
    assert {r.psnr for r in scores.score(df, "psnr", ["time"]).collect()} == {100.0}
    clim = seeps.seeps_climatology(df, light=0.5)
    assert value(seeps.seeps(df, clim), "seeps") == pytest.approx(1.0)
    assert value(distribution.iqd(df), "iqd") == 0


def test_scores_equal_numpy_and_skip_missing(make_fields):
    f, o = RNG.normal(size=(2, 5, 4, 3))
    f[0, 0, 0] = np.nan
    df = make_fields(fcst=f, ref_=o)
    for t, row in enumerate(scores.scores_by(df, ["bias", "mae", "mse", "rmse"], ["time"]).orderBy("time").collect()):
        d = f[t] - o[t]
        assert row.bias == pytest.approx(np.nanmean(d)) and row.mae == pytest.approx(np.nanmean(abs(d)))
        assert row.mse == pytest.approx(np.nanmean(d ** 2)) and row.rmse == pytest.approx(np.nanmean(d ** 2) ** 0.5)
    l1 = value(scores.score(df, "l1", avg_dims=["iy", "ix"]), "l1")
    assert l1 == pytest.approx(np.nansum(abs(f - o)) / 12)


def test_psnr_of_partly_perfect_forecast(make_fields):
    f, o = np.zeros((2, 2, 2)), np.zeros((2, 2, 2))
    o[1] = 0.5
    got = {r.time: r.psnr for r in scores.score(make_fields(fcst=f, ref_=o), "psnr", ["time"]).collect()}
    assert got[0] == float("inf") and got[1] == pytest.approx(20 * np.log10(2))


def test_unknown_names(make_fields):
    df = make_fields(fcst=np.zeros((1, 2, 2)), ref_=np.zeros((1, 2, 2)))
    with pytest.raises(ValueError, match="rmse"):
        scores.score(df, "nope")
    with pytest.raises(ValueError):
        scores.score(df, "l1", avg_dims=["depth"])
    with pytest.raises(ValueError):
        distribution.conditional_quantiles(df, "other")
    with pytest.raises(ValueError):
        distribution.conditional_quantiles(df, quantiles=(0.5,))
    with pytest.raises(ValueError):
        gradient.amplitude_ratio(df, order=2)


def test_acc_variants(make_fields):
    f, o = RNG.gamma(2, 1, size=(2, 3, 4, 4))
    df = make_fields(fcst_ano=f, ref__ano=o)
    got = value(scores.acc(df), "acc")
    want = np.mean([(f[t] * o[t]).sum() / np.sqrt((f[t] ** 2).sum() * (o[t] ** 2).sum()) for t in range(3)])
    assert got == pytest.approx(want)
    got = value(scores.acc(df, variant="as_written"), "acc")
    want = np.mean([(f[t] * o[t]).sum() / np.sqrt(f[t].sum() * o[t].sum()) for t in range(3)])
    assert got == pytest.approx(want)


def test_seeps_weights(spark):
    row = spark.range(1).select(seeps.seeps_weights(F.lit(0.4), F.lit(0.25)).alias("w"),
                                seeps.seeps_weights(F.lit(0.0), F.lit(1.0)).alias("edge")).first()
    np.testing.assert_allclose(row.w, [0, 1 / 0.6, 4 + 1 / 0.6, 2.5, 0, 4, 2.5 + 1 / 0.75, 1 / 0.75, 0])
    assert row.edge[3] is None and row.edge[7] is None and row.edge[0] is None


@pytest.mark.parametrize("hours", [0, 1, 3])
def test_iqd_equals_interpolation_of_the_sorted_sample(make_fields, hours):
    f = RNG.gamma(0.7, 4, size=(20, 5, 5)).round(1)
    o = RNG.gamma(0.9, 3, size=(20, 5, 5)).round(1)
    f[0, 0, :2] = np.nan
    nodes = distribution.default_nodes(hours)

    def cdf(v):
        s = np.sort(v[v > 0].ravel())
        return np.interp(nodes, s, np.arange(len(s)) / (len(s) - 1))
    want = np.trapezoid((cdf(o) - cdf(f)) ** 2, nodes)
    assert value(distribution.iqd(make_fields(fcst=f, ref_=o), hours=hours), "iqd") == pytest.approx(want, abs=1e-12)


def test_iqd_of_single_values_is_missing(make_fields):
    one = make_fields(fcst=np.ones((1, 1, 1)), ref_=np.ones((1, 1, 1)))
    assert value(distribution.iqd(one), "iqd") is None


def test_conditional_quantiles(make_fields):
    f, o = RNG.normal(5, 3, size=(2, 40, 5, 5))
    got = {r.bin_center: r for r in distribution.conditional_quantiles(make_fields(fcst=f, ref_=o)).collect()}
    lo, hi = int(np.floor(min(f.min(), o.min()))), int(np.ceil(max(f.max(), o.max())))
    assert sorted(got) == [b + 0.5 for b in range(lo, hi)]
    for b in range(lo, hi):
        inside = o[(f >= b) & (f < b + 1)]
        row = got[b + 0.5]
        if len(inside) == 0:
            assert row.q50 is None
        else:
            np.testing.assert_allclose([row.q05, row.q50, row.q95], np.quantile(inside, [0.05, 0.5, 0.95]), atol=1e-9)


def test_conditional_quantiles_top_bin(make_fields):
    # a value at the integer maximum belongs to no bin; integer constants give no bins at all
    f = np.array([[[0.5, 1.0, 2.0]]])
    o = np.array([[[0.1, 0.2, 2.9]]])
    got = {r.bin_center: r.q50 for r in distribution.conditional_quantiles(make_fields(fcst=f, ref_=o)).collect()}
    assert got == {0.5: 0.1, 1.5: 0.2, 2.5: None}
    const = make_fields(fcst=np.full((1, 2, 2), 3.0), ref_=np.full((1, 2, 2), 3.0))
    assert distribution.conditional_quantiles(const).count() == 0


def test_gradient_equals_numpy(make_fields):
    v = RNG.normal(size=(2, 8, 8))
    lat, lon = 48 + 0.5 * np.arange(8), 6 + 0.5 * np.arange(8)
    step = 6371e3 * np.radians(0.5)
    got = {r.time: r.grad_v for r in gradient.spatial_gradient(make_fields(GRID, v=v), ["v"], 0.5, 0.5).collect()}
    for t in range(2):
        gx = np.gradient(v[t], lon, axis=1) / (step * np.cos(np.radians(lat))[:, None])
        gy = np.gradient(v[t], lat, axis=0) / step
        assert got[t] == pytest.approx(np.sqrt(gx ** 2 + gy ** 2).mean(), rel=1e-12)


def test_gradient_in_metres_of_a_plane(make_fields):
    lat = 48 + 0.5 * np.arange(8)[:, None]
    v = np.broadcast_to(2 * lat, (8, 8))[None]
    row = gradient.spatial_gradient(make_fields(GRID, v=v), ["v"], 0.5, 0.5, si=True).first()
    assert row.grad_v == pytest.approx(2 / (6371e3 * np.radians(1)), rel=1e-9)


def test_difference_next_to_a_gap_is_missing(make_fields):
    df = make_fields(GRID, v=RNG.normal(size=(1, 8, 8))).where("NOT (iy = 0 AND ix = 3)")
    out = df.withColumn("d", gradient.centered_difference(F.col("v"), F.col("lon"), "ix", ["time", "iy"]))
    lost = {r.ix for r in out.where("iy = 0 AND d IS NULL").collect()}
    assert lost == {2, 4} and out.where("iy > 0 AND d IS NULL").count() == 0


def numpy_spectrum(field, cut=4):
    ny, nx = field.shape
    for axis, n in ((1, nx), (0, ny)):
        slope = (np.take(field, [-1], axis) - np.take(field, [0], axis)) / (n - 1)
        k = 2 * np.arange(n) - n
        field = field - 0.5 * slope * (k[None, :] if axis == 1 else k[:, None])
    power = abs(np.fft.fft2(field) / (nx * ny)) ** 2
    rings, _ = spectrum.ring_layout(GRID)
    return field, [power[rings == k].sum() for k in range(cut)]


def test_detrend_and_spectrum_equal_numpy(make_fields, to_array):
    v = RNG.normal(size=(3, 8, 8)).cumsum(axis=2)
    df = make_fields(GRID, v=v)
    flat = to_array(spectrum.detrend_field(df, "v", 8, 8), "detrended")
    got = {(r.time, r.k): r.power for r in spectrum.power_spectrum(df, ["v"], GRID).collect()}
    for t in range(3):
        want_flat, want = numpy_spectrum(v[t])
        np.testing.assert_allclose(flat[t], want_flat, atol=1e-12)
        np.testing.assert_allclose([got[t, k] for k in range(4)], want, atol=1e-15)


def test_spectrum_of_a_wave_and_of_a_gap(make_fields):
    x = np.arange(8)
    wave = np.broadcast_to(np.cos(4 * np.pi * x / 8), (8, 8))[None]
    rows = spectrum.power_spectrum(make_fields(GRID, v=np.concatenate([wave, np.ones((1, 8, 8))])), ["v"], GRID).collect()
    got = {(r.time, r.k): r.power for r in rows}
    assert max(range(1, 4), key=lambda k: got[0, k]) == 2
    assert got[1, 0] == pytest.approx(1.0) and got[1, 1] == pytest.approx(0.0)
    gap = make_fields(GRID, v=np.ones((2, 8, 8))).where("NOT (time = 1 AND iy = 2 AND ix = 2)")
    assert {r.time for r in spectrum.power_spectrum(gap, ["v"], GRID).collect()} == {0}


def test_two_values_for_one_cell_are_an_error(make_fields):
    df = make_fields(GRID, v=np.ones((1, 8, 8)))
    with pytest.raises(Exception, match="more than one value"):
        spectrum.power_spectrum(df.unionByName(df.limit(1)), ["v"], GRID).collect()


def test_normalisation_round_trip(make_fields, to_array):
    v = RNG.normal(3, 2, size=(6, 4, 4))
    df = make_fields(v=v, c=np.full((6, 4, 4), 2.0))
    st = normalize.zscore_stats(df, ["v"])
    z = normalize.zscore_normalize(df, ["v"], st)
    np.testing.assert_allclose(to_array(z, "v"), (v - v.mean()) / v.std(), atol=1e-12)
    np.testing.assert_allclose(to_array(normalize.zscore_denormalize(z, ["v"], st), "v"), v, atol=1e-12)
    cell = normalize.zscore_normalize(df, ["v"], by=["iy", "ix"])
    np.testing.assert_allclose(to_array(cell, "v"), (v - v.mean(0)) / v.std(0), atol=1e-12)
    assert normalize.zscore_normalize(df, ["c"]).where("c IS NOT NULL").count() == 0


def test_boxplot_and_breakdown(spark):
    df = spark.createDataFrame([("a", float(v)) for v in [1, 2, 3, 4, 5, 30]], "p string, v double")
    row = evaluate.boxplot_stats(df, "v", ["p"]).first()
    assert (row.q1, row.median, row.q3) == (2.25, 3.5, 4.75)
    assert (row.whisker_lo, row.whisker_hi, row.outlier_max) == (1.0, 5.0, 30.0)


@pytest.mark.parametrize("n", [1, 16])
def test_results_do_not_depend_on_partitions(spark, make_fields, n):
    f, o = np.random.default_rng(6).gamma(1, 3, size=(2, 30, 4, 4))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", n)
    try:
        df = make_fields(fcst=f, ref_=o).repartition(n)
        assert value(distribution.iqd(df), "iqd") == pytest.approx(value(distribution.iqd(df.coalesce(1)), "iqd"), abs=1e-14)
        got = distribution.conditional_quantiles(df).collect()
        inside = o[(f >= 1) & (f < 2)]
        assert [r.q50 for r in got if r.bin_center == 1.5] == [pytest.approx(np.median(inside))]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_registry_knows_every_score(make_fields):
    f, o = np.random.default_rng(9).gamma(1, 3, size=(2, 8, 8, 8))
    df = make_fields(GRID, fcst=f, ref_=o)
    options = {"seeps": {"params": seeps.seeps_climatology(df, light=0.5)}, "ets": {"thresh": 2.0},
               "grad_amplitude": {"dlon": 0.5, "dlat": 0.5},
               "acc": {"fcst": "fcst", "ref": "ref_"}}
    for name in scores.REGISTRY:
        out = scores.score(df, name, ["time"] if name not in ("l1", "l2", "iqd") else (), **options.get(name, {}))
        assert out.columns[-1] in (name, "complete") and out.count() == (1 if name in ("l1", "l2", "iqd") else 8)
