from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.columns import choose_vars, coordinate, missing_names, nan_to_null
from gridspark.functions import calendar, names
from gridspark.functions.quantiles import grouped_quantiles, wide_quantiles
from gridspark.functions.ranking import row_numbers, shuffled_ranks, time_ranks


def test_quantiles_equal_numpy_with_one_hot_key(spark):
    rng = np.random.default_rng(1)
    groups = {"hot": rng.gamma(0.5, 3, 4000).round(1), "cold": rng.normal(size=37), "same": np.full(50, 2.5),
              "single": np.array([7.0])}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("hot", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = [0.0, 0.05, 0.25, 0.5, 2 / 3, 0.95, 1.0]
    got = {(r.k, r.prob): r.q for r in grouped_quantiles(df, ["k"], "v", probs).collect()}
    want = {(k, p): np.quantile(vs, p) for k, vs in groups.items() for p in probs}
    assert got.keys() == want.keys()
    assert all(got[key] == pytest.approx(want[key], abs=1e-12) for key in want)


def test_quantiles_without_keys(spark):
    df = spark.range(1001).select((F.col("id") * 1.0).alias("v"))
    row = wide_quantiles(df, [], "v", {"a": 0.1, "b": 0.9995}).first()
    assert (row.a, row.b) == (pytest.approx(100.0), pytest.approx(999.5))


def test_row_numbers_equal_one_sort(spark):
    rng = np.random.default_rng(2)
    values = rng.permutation(3000).tolist()
    df = spark.createDataFrame([(v, v % 3) for v in values], "v bigint, k bigint")
    plain = {r.v: r.rn for r in row_numbers(df, F.floor(F.col("v") / 100), [F.col("v")]).collect()}
    assert plain == {v: v + 1 for v in values}
    keyed = row_numbers(df, F.floor(F.col("v") / 100), [F.col("v")], ["k"]).collect()
    assert all(r.rn == r.v // 3 + 1 for r in keyed)


def test_shuffled_ranks_are_a_permutation_and_depend_on_the_seed_only(spark):
    df = spark.range(500).select(F.col("id").alias("v"))
    a = {r.v: r.rn for r in shuffled_ranks(df, 1, ["v"]).collect()}
    b = {r.v: r.rn for r in shuffled_ranks(df.repartition(7), 1, ["v"]).collect()}
    c = {r.v: r.rn for r in shuffled_ranks(df, 2, ["v"]).collect()}
    assert sorted(a.values()) == list(range(1, 501))
    assert a == b and a != c


def test_time_ranks(spark):
    start = dt.datetime(2019, 12, 30)
    times = [(start + dt.timedelta(days=i),) for i in range(70)]
    df = spark.createDataFrame(times[::-1], "time timestamp_ntz")
    assert [r.time for r in time_ranks(df).orderBy("rn").collect()] == [t[0] for t in times]


def test_calendar(spark):
    row = spark.range(1).select(
        F.size(calendar.hourly_axis(F.lit(dt.date(2020, 2, 5)))).alias("n"),
        calendar.doy_to_date(F.lit(60), F.lit(2020)).alias("leap"),
        calendar.doy_to_date(F.lit(60), F.lit(2019)).alias("plain"),
        calendar.extract_date(F.lit("2018030412_sf.grb")).alias("a"),
        calendar.extract_date(F.lit("run_2018-03-04.nc")).alias("b"),
        calendar.extract_date(F.lit("nothing")).alias("c"),
        calendar.ensure_datetime(F.lit("2018-03-04 05:06:07")).alias("d"),
        calendar.ensure_datetime(F.lit("x")).alias("e")).first()
    assert row.n == 29 * 24
    assert (row.leap, row.plain) == (dt.date(2020, 2, 29), dt.date(2019, 3, 1))
    assert (row.a, row.b, row.c) == (dt.datetime(2018, 3, 4, 12), dt.datetime(2018, 3, 4), None)
    assert (row.d, row.e) == (dt.datetime(2018, 3, 4, 5, 6, 7), None)


@pytest.mark.parametrize("model,offset,hour,init,lead", [
    ("era5", 6, 11, "2019-12-31 18:00", 17), ("era5", 6, 12, "2020-01-01 06:00", 6),
    ("era5", 6, 23, "2020-01-01 06:00", 17), ("ifs", 6, 5, "2019-12-31 12:00", 17),
    ("ifs", 6, 17, "2020-01-01 00:00", 17), ("ifs", 6, 18, "2020-01-01 12:00", 6),
    ("era5", 3, 22, "2020-01-01 18:00", 4)])
def test_forecast_run(spark, model, offset, hour, init, lead):
    valid = F.lit(dt.datetime(2020, 1, 1, hour)).cast("timestamp_ntz")
    run = calendar.forecast_run(valid, model, offset)
    row = spark.range(1).select(run["run_init"].alias("i"), run["lead"].alias("l")).first()
    assert (row.i, row.l) == (dt.datetime.fromisoformat(init), lead)


def test_forecast_run_errors():
    for args in (("era5", 12), ("gfs", 6)):
        with pytest.raises(ValueError):
            calendar.forecast_run(F.lit(None), *args)
    with pytest.raises(ValueError):
        calendar.season_months("spring")
    assert calendar.season_months("MMA") == calendar.season_months("MAM")


def test_names(spark):
    row = spark.range(1).select(
        names.natural_key(F.lit("/a/2b/era5_10.nc")).alias("k"), names.natural_key(F.lit("none")).alias("no"),
        names.experiment_id(F.lit("/x/eval_id12ab_rmse.csv")).alias("e"),
        names.shape_of(F.lit("out/pred_s_8_16_phys.dat")).alias("s"),
        names.level_name(F.lit("t"), F.lit(92500)).alias("l"),
        names.pressure_levels(F.array(F.lit("p92500"), F.lit("p85000"), F.lit("p85000"))).alias("p")).first()
    assert (row.k, row.no, row.e, row.s, row.l, row.p) == (5, None, "12ab", [8, 16], "t925", [85000, 92500])


def test_bad_level_and_variable_type_are_errors(spark):
    bad = spark.range(1).select(names.pressure_levels(F.array(F.lit("p850"), F.lit("ml96"))).alias("x"))
    with pytest.raises(Exception, match="ml96"):
        bad.collect()
    df = spark.createDataFrame([('{"sf": {"2t": null}, "zz": {"t": ["p1"]}}',)], "text string")
    with pytest.raises(Exception, match="zz"):
        names.predictor_rows(df, "text").collect()


def test_columns(spark):
    df = spark.createDataFrame([(1.0, float("nan"), "x")], "t_in double, t_tar double, s string")
    assert nan_to_null(df).first().t_tar is None
    assert choose_vars(df, suffix="_in") == ["t_in"]
    with pytest.raises(ValueError, match="u_in, v_in"):
        choose_vars(df, ["t_in", "u_in", "v_in"])
    assert missing_names(["a", "b"], ["c", "b", "a", "d"]) == ["c", "d"]
    with pytest.raises(ValueError):
        coordinate(df, ("rlat", "lat"))


def test_count_up_in_small_chunks(spark):
    from gridspark.functions.ranking import count_up

    df = spark.createDataFrame([("a", 7), ("b", 0), ("c", 3)], "k string, n int")
    rows = count_up(df, F.col("n"), "i", chunk=3).collect()
    assert sorted((r.k, r.i) for r in rows) == [("a", i) for i in range(7)] + [("c", i) for i in range(3)]


def test_natural_order_with_one_first_integer_for_all(spark):
    from gridspark.operators.select import natural_order

    files = spark.createDataFrame([(f"era5_{i}.nc",) for i in range(3000, 0, -1)] + [("first.nc",)], "fname string")
    got = {r.fname: r.pos for r in natural_order(files).collect()}
    assert got["first.nc"] == 1 and all(got[f"era5_{i}.nc"] == i + 1 for i in range(1, 3001))
