"""Selection, alignment, resampling, samples, sources, streams and models."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.operators import align, model, normalize, resample, reshape, samples, select
from gridspark.plans.training import prepare_samples
from gridspark.plans.verify import evaluate, verification_table
from gridspark.session import scratch_dir
from gridspark.sources import exchange, tables
from gridspark.streaming import ingest

RNG = np.random.default_rng(7)


@pytest.fixture(scope="module")
def daily(spark):
    """Three months of daily 2x2 fields."""
    start = dt.datetime(2020, 1, 1)
    rows = [(start + dt.timedelta(days=d), iy, ix, float(RNG.normal()), float(RNG.normal()))
            for d in range(91) for iy in range(2) for ix in range(2)]
    return spark.createDataFrame(rows, "time timestamp_ntz, iy int, ix int, t_in double, t_tar double")


def test_flip_twice_is_the_original(spark, make_fields):
    df = make_fields(v=RNG.normal(size=(2, 3, 4))).withColumn(
        "time", F.timestamp_seconds(F.col("time") * 3600).cast("timestamp_ntz"))
    once = reshape.flip_augment(df, 4, 3)
    assert once.count() == 4 * df.count() and once.select("time", "iy", "ix").distinct().count() == once.count()
    for k in range(4):
        one = once.where(f"copy = {k}").drop("copy")
        again = reshape.flip_augment(one, 4, 3).where(f"copy = {k}")
        back = again.withColumn("time", F.col("time") - F.make_dt_interval(mins=F.lit(2 * k))).select(*df.columns)
        assert back.exceptAll(df).count() == 0


def test_splits_must_be_exhaustive(daily):
    label = select.split_label(F.col("time"), {"train": [([2020], [1, 2])]})
    with pytest.raises(Exception, match="time in no split"):
        daily.select(label).collect()


def test_empty_selections_are_errors(daily, spark):
    with pytest.raises(ValueError):
        align.merge_on_time_intersection(daily.where("month(time) = 1").drop("t_tar"),
                                         daily.where("month(time) = 2").drop("t_in"))
    files = spark.createDataFrame([("sf_2020010112.nc",)], "fname string")
    assert select.subset_files_on_date(files, 12).count() == 1
    with pytest.raises(ValueError):
        select.subset_files_on_date(files, 13)
    with pytest.raises(ValueError):
        align.align_fcst_ref(daily, daily.drop("t_in"))


def test_cap_and_first(daily):
    assert select.cap_samples(daily, 10).agg(F.max("time")).first()[0] == dt.datetime(2020, 1, 10)
    assert select.first_sample(daily).count() == 4


def test_static_variables(daily):
    df = daily.withColumn("z", F.col("iy") + 10.0 * F.col("ix"))
    flags = {r.variable: r.is_static for r in reshape.static_flags(df, ["t_in", "z"]).collect()}
    assert flags == {"t_in": False, "z": True}
    static, dynamic = reshape.split_static_dynamic(df)
    assert static.count() == 4 and "z" not in dynamic.columns
    assert reshape.broadcast_static(dynamic, static).where("z IS NULL").count() == 0
    assert reshape.broadcast_static(df, static).columns == df.columns


def test_field_tensor_channels(make_fields):
    a, b = RNG.normal(size=(2, 2, 3, 4))
    rows = reshape.field_tensor(make_fields(a=a, b=b), ["a"], ["b"], 4, 3).orderBy("time").collect()
    for t, row in enumerate(rows):
        np.testing.assert_allclose(np.array(row.tensor).reshape(3, 4, 2), np.stack([a[t], b[t]], -1), atol=1e-6)


def test_bootstrap(spark):
    start = dt.datetime(2020, 1, 1)
    v = RNG.normal(2, 1, 205)
    df = spark.createDataFrame([(start + dt.timedelta(days=i), float(x)) for i, x in enumerate(v)],
                               "time timestamp_ntz, v double")
    blocks = resample.block_means(df, ["v"], 10)
    got = {r.iblock: r.v for r in blocks.collect()}
    np.testing.assert_allclose([got[i] for i in range(20)], v[:200].reshape(20, 10).mean(1))
    boots = resample.block_bootstrap(blocks, ["v"], 500)
    row = boots.agg(F.count("*").alias("n"), F.avg("v_bootstrapped").alias("m"), F.stddev("v_bootstrapped").alias("s")).first()
    block = v[:200].reshape(20, 10).mean(1)
    assert row.n == 500 and row.m == pytest.approx(block.mean(), abs=0.05)
    assert row.s == pytest.approx(block.std() / np.sqrt(20), rel=0.2)
    assert {r.iboot: r.v_bootstrapped for r in boots.collect()} == pytest.approx(
        {r.iboot: r.v_bootstrapped for r in resample.block_bootstrap(blocks.repartition(5), ["v"], 500).collect()})
    with pytest.raises(Exception, match="too few"):
        resample.block_bootstrap(resample.block_means(df, ["v"], 21), ["v"], 5).collect()


def test_permutation_keeps_values_and_patches(make_fields, to_array):
    v = RNG.normal(size=(5, 4, 6))
    out = to_array(resample.sample_permut_xyt(make_fields(v=v), 6, 4, (2, 3), 3), "v")
    assert sorted(out.ravel()) == pytest.approx(sorted(v.ravel()))
    patches = {tuple(p.ravel().round(9)) for t in v for p in (t[:2, :3], t[:2, 3:], t[2:, :3], t[2:, 3:])}
    moved = {tuple(p.ravel().round(9)) for t in out for p in (t[:2, :3], t[:2, 3:], t[2:, :3], t[2:, 3:])}
    assert patches == moved and not np.allclose(out, v)
    with pytest.raises(ValueError):
        resample.permute_patches(make_fields(v=v), 6, 4, (3, 3), 1)


def test_importance_finds_the_predictor_that_matters(make_fields):
    a, b = RNG.normal(size=(2, 6, 4, 4))
    df = make_fields(a=a, b=b, y=3 * a)
    coefficients = model.fit_linear(df, ["a", "b"], "y")
    assert coefficients == pytest.approx({"a": 3.0, "b": 0.0, "intercept": 0.0}, abs=1e-9)
    predict = model.linear_prediction(coefficients)
    got = model.feature_importance(df, ["a", "b"], "y", 4, 4, predict, patch=(2, 2))
    mean = {r.predictor: r.s for r in got.groupBy("predictor").agg(F.avg("score").alias("s")).collect()}
    assert mean["a"] > 1 and mean["b"] == pytest.approx(0, abs=1e-9)

    def external(table):
        return model.batch_inference(table, lambda x: 3 * x["a"], ["a"], ["predictor", "time", "iy", "ix", "y"])
    again = model.feature_importance(df, ["a", "b"], "y", 4, 4, external, patch=(2, 2)).collect()
    assert {(r.predictor, r.time): r.score for r in again} == pytest.approx(
        {(r.predictor, r.time): r.score for r in got.collect()}, abs=1e-6)


def test_attach_coords_takes_the_first_channel(spark):
    df = spark.createDataFrame([(0, [[1.0, 9.0], [2.0, 9.0], [3.0, 9.0], [4.0, 9.0]])], "time int, f array<array<double>>")
    coords = spark.createDataFrame([(y, x) for y in range(2) for x in range(2)], "iy int, ix int")
    stats = spark.createDataFrame([(10.0, 2.0)], "mu double, sigma double")
    rows = align.attach_coords(df, "f", 2, coords, stats, z_branch=True).collect()
    assert {(r.iy, r.ix): r.value for r in rows} == {(0, 0): 12.0, (0, 1): 14.0, (1, 0): 16.0, (1, 1): 18.0}


def test_groups_padding_batches_epochs(daily, spark):
    months = daily.select(F.date_format("time", "yyyy-MM").alias("group_id"), "time").distinct()
    padded = samples.pad_groups(months)
    assert {r["count"] for r in padded.groupBy("group_id").count().collect()} == {31}
    extra = padded.where("padded").orderBy("time").collect()
    assert [r.time for r in extra] == [dt.datetime(2020, 3, 1), dt.datetime(2020, 3, 2)]
    gaps = {(b.source_time - a.source_time).days for a, b in zip(extra, extra[1:])}
    assert gaps == {1}
    tiny = spark.createDataFrame([("a", dt.datetime(2020, 1, d)) for d in (1, 2)]
                                 + [("b", dt.datetime(2020, 1, d)) for d in range(1, 8)], "group_id string, time timestamp_ntz")
    assert samples.pad_groups(tiny).where("group_id = 'a'").count() == 7

    batches = samples.minibatch(months, 5, d_steps=1)
    assert batches.count() == 91
    sizes = {(r.group_id, r.batch_id): r["count"] for r in batches.groupBy("group_id", "batch_id").count().collect()}
    assert sizes[("2020-01", 0)] == 10 and sizes[("2020-01", 3)] == 1
    whole = samples.minibatch(months, 5, d_steps=1, drop_remainder=True)
    assert {r["count"] for r in whole.groupBy("group_id", "batch_id", "sub_step").count().collect()} == {5}

    rounds = samples.epochs(months, 2)
    orders = {e: [r.time for r in rounds.where(f"epoch = {e} AND group_id = '2020-01'").orderBy("step").collect()] for e in (0, 1)}
    assert sorted(orders[0]) == sorted(orders[1]) and orders[0] != orders[1]
    files = spark.range(12).select(F.col("id").alias("month"))
    grouped = samples.file_groups(files, 5)
    assert {r["count"] for r in grouped.groupBy("group_id").count().collect()} == {4}


def test_shards_cover_all_times_once(daily):
    parts = [samples.shard(daily, r, 3) for r in range(3)]
    assert sum(p.count() for p in parts) == daily.count()
    assert parts[1].agg(F.min("time")).first()[0] == dt.datetime(2020, 1, 2)
    with pytest.raises(ValueError):
        samples.shard(daily, 3, 3)


def test_prepare_samples_needs_statistics(daily):
    df = daily.withColumn("group_id", F.month("time"))
    train, stats = prepare_samples(df.where("group_id < 3"), "train", ["t_in"], ["t_tar"], 8)
    assert train.agg(F.avg("t_in")).first()[0] == pytest.approx(0, abs=1e-6)
    assert dict(train.dtypes)["t_in"] == "float"
    with pytest.raises(ValueError, match="statistics"):
        prepare_samples(df, "val", ["t_in"], ["t_tar"], 8)
    val, _ = prepare_samples(df.where("group_id = 3"), "val", ["t_in"], ["t_tar"], 8, stats=stats)
    assert val.count() == 31 * 4


def test_subsets(spark, daily):
    base = scratch_dir(spark, "t")
    tables.write_dataset(daily.withColumn("subset", F.when(F.month("time") < 3, "train").otherwise("val")), base, "d")
    got = tables.scan_subset(spark, base, ["d"], "d", "val")
    assert got.count() == 31 * 4
    plan = got._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "subset" in plan.split("PartitionFilters: [")[1].split("]")[0]
    for args in (("x", "val"), ("d", "dev")):
        with pytest.raises(ValueError):
            tables.scan_subset(spark, base, ["d"], *args)
    with pytest.raises(ValueError):
        tables.scan_subset(spark, base, ["d"], "d", "val", augmented=True)


def test_statistics_file(spark):
    stats = spark.createDataFrame([("t", 1.0, 2.0)], "variable string, mu double, sigma double")
    path = scratch_dir(spark, "stats")
    exchange.write_stats(stats, path)
    assert exchange.read_stats(spark, path).collect() == stats.collect()
    with pytest.raises(Exception, match="z_score"):
        exchange.read_stats(spark, path, "min_max").collect()
    with pytest.raises(ValueError):
        exchange.write_stats(stats.withColumn("sigma", F.lit(None).cast("double")), path + "x")
    with pytest.raises(ValueError):
        exchange.write_stats(stats.limit(0), path + "y")


def test_verification_job(spark, daily):
    fcst = daily.select("time", "iy", "ix", F.col("t_in").alias("value"))
    ref = daily.select("time", "iy", "ix", F.col("t_tar").alias("value"))
    stored = verification_table(fcst, ref, scratch_dir(spark, "v"))
    out = evaluate(stored, ["rmse", "bias"])
    assert out["rmse"]["per_time"].count() == 91 and out["map"]["all"].count() == 4
    assert out["bias"]["breakdown"].count() == 2 + 1 + 2 + 1


def test_stream_equals_batch_in_two_rounds(spark, daily):

    base = scratch_dir(spark, "s")
    stats = normalize.zscore_stats(daily.where("month(time) = 1"), ["t_in", "t_tar"])
    for months in ("month(time) < 3", "month(time) = 3"):
        tables.write_monthly(daily.where(months), f"{base}/in", mode="append")
        ingest.stream_normalize(spark, f"{base}/in", daily.schema, stats, ["t_in", "t_tar"], f"{base}/out",
                                f"{base}/check").awaitTermination()
    got = spark.read.parquet(f"{base}/out")
    assert got.count() == daily.count()
    batch = normalize.zscore_normalize(daily, ["t_in", "t_tar"], stats)
    diff = got.alias("a").join(batch.alias("b"), ["time", "iy", "ix"]).agg(F.max(F.abs(F.col("a.t_in") - F.col("b.t_in")))).first()[0]
    assert diff < 1e-6


def test_error_budget(spark, daily):
    # the first days of three months fail
    bad = (F.dayofmonth("time") == 1) & (F.col("iy") == 0)
    n_bad = daily.where(bad).count()
    assert ingest.error_budget(daily, bad, 3).count() == daily.count() - n_bad
    with pytest.raises(ValueError, match="3 pieces"):
        ingest.error_budget(daily, bad, 2)
    base = scratch_dir(spark, "b")
    tables.write_monthly(daily, f"{base}/in")
    ingest.stream_with_budget(spark, f"{base}/in", daily.schema, bad, f"{base}/out", f"{base}/c", 3).awaitTermination()
    assert spark.read.parquet(f"{base}/out").count() == daily.count() - n_bad
    with pytest.raises(Exception, match="tolerated"):
        ingest.stream_with_budget(spark, f"{base}/in", daily.schema, bad, f"{base}/out2", f"{base}/c2", max_warn=1).awaitTermination()


def test_second_stream_adds_to_the_sink(spark, daily):
    base, never = scratch_dir(spark, "b"), F.lit(False)
    early, late = daily.where("month(time) = 1"), daily.where("month(time) > 1")
    for name, part in (("a", early), ("b", late)):
        part.write.parquet(f"{base}/{name}")
        ingest.stream_with_budget(spark, f"{base}/{name}", daily.schema, never, f"{base}/out", f"{base}/c{name}").awaitTermination()
    assert spark.read.parquet(f"{base}/out").count() == daily.count()
    # what earlier runs used of the budget counts
    bad = F.col("iy") == 0
    with pytest.raises(Exception, match="tolerated"):
        for name in ("a", "b"):
            ingest.stream_with_budget(spark, f"{base}/{name}", daily.schema, bad, f"{base}/out3", f"{base}/d{name}",
                                      max_warn=early.select("time").distinct().count()).awaitTermination()


def test_rows_without_a_verdict_have_failed(spark, daily):
    bad = F.when(F.col("ix") > 0, F.lit(False))
    good = ingest.error_budget(daily, bad, 10_000)
    counts = ingest.bad_per_month(daily, bad).agg(F.sum("n_bad"), F.sum("n_good")).first()
    assert good.count() == counts[1] == daily.where("ix > 0").count() and sum(counts) == daily.count()


def test_incremental_steps(spark, daily):
    path = scratch_dir(spark, "m")
    tables.write_monthly(daily.where("month(time) = 1 OR (month(time) = 2 AND day(time) < 10)"), path)
    missing = tables.missing_steps(daily, spark.read.parquet(path))
    assert missing.agg(F.min("time")).first()[0] == dt.datetime(2020, 2, 10) and missing.columns == daily.columns
    tables.append_missing(daily, path)
    tables.append_missing(daily, path)
    assert spark.read.parquet(path).count() == daily.count()


def test_stream_reads_the_training_data_once(spark, daily):
    base = scratch_dir(spark, "frozen")
    tables.write_monthly(daily, f"{base}/in")
    read = spark.sparkContext.accumulator(0)

    def count(frames):
        for f in frames:
            read.add(len(f))
            yield f
    training = daily.mapInPandas(count, daily.schema)
    stats = normalize.zscore_stats(training, ["t_in"])
    ingest.stream_normalize(spark, f"{base}/in", daily.schema, stats, ["t_in"], f"{base}/out", f"{base}/check").awaitTermination()
    assert read.value == daily.count() and spark.read.parquet(f"{base}/out").count() == daily.count()


def test_statistics_must_be_there_once(spark, daily):
    stats = normalize.zscore_stats(daily, ["t_in"])
    with pytest.raises(Exception, match="no statistics of 't_tar'"):
        normalize.zscore_normalize(daily, ["t_in", "t_tar"], stats).collect()
    with pytest.raises(Exception, match="several statistics"):
        normalize.zscore_normalize(daily, ["t_in"], stats.union(stats)).collect()
    cell = normalize.zscore_stats(daily, ["t_in"], ["iy", "ix"])
    with pytest.raises(ValueError, match="t_tar"):
        normalize.zscore_normalize(daily, ["t_in", "t_tar"], cell, ["iy", "ix"])
    path = scratch_dir(spark, "stats")
    exchange.write_stats(cell, path)
    assert sorted(exchange.read_stats(spark, path, keys="iy int, ix int").collect()) == sorted(cell.collect())
    with pytest.raises(ValueError, match="keys"):
        exchange.read_stats(spark, path)


def test_cells_outside_the_grid_are_errors(spark, daily):
    with pytest.raises(Exception, match="outside the grid"):
        reshape.field_tensor(daily, ["t_in"], ["t_tar"], 1, 1).collect()
    with pytest.raises(Exception, match="outside the grid"):
        resample.permute_patches(daily, 1, 1, (1, 1), 3).collect()
    moving = daily.withColumn("z", F.col("t_in"))
    with pytest.raises(Exception, match="not static"):
        reshape.split_static_dynamic(moving)[0].collect()


def test_bootstrap_per_key_shares_draws(spark):
    start = dt.datetime(2020, 1, 1)
    rows = [(start + dt.timedelta(days=i), m, float(i + 1000 * m)) for i in range(125) for m in range(3)]
    df = spark.createDataFrame(rows, "time timestamp_ntz, member int, v double")
    blocks = resample.block_means(df, ["v"], 10, keys=["member"])
    assert blocks.count() == 36
    boots = {(r.member, r.iboot): r.v_bootstrapped for r in resample.block_bootstrap(blocks, ["v"], 7, keys=["member"]).collect()}
    assert all(boots[2, i] == pytest.approx(boots[0, i] + 2000) for i in range(7))
    with pytest.raises(Exception, match="name the other dimensions"):
        resample.block_means(df, ["v"], 10).collect()


def test_scratch_folder_must_be_shared_on_a_cluster():
    class Cluster:
        class conf:  # noqa: N801
            @staticmethod
            def get(key, default=None):
                return None

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

            @staticmethod
            def getCheckpointDir():
                return None
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_dir(Cluster, "x")
