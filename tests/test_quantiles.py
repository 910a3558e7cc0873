"""Exact quantiles over many keys, large keys and both."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.functions import quantiles
from gridspark.functions.quantiles import grouped_quantiles, with_quantiles

PROBS = [0.0, 0.05, 1 / 3, 0.5, 0.95, 1.0]


@pytest.fixture(scope="module")
def groups():
    rng = np.random.default_rng(11)
    found = {k: rng.normal(k, 1, rng.integers(1, 40)).round(2) for k in range(60)}
    found[100] = rng.normal(0, 1, 20_000).round(3)
    found[101] = np.r_[np.full(9_000, 5.0), rng.random(3_000)]
    found[102] = np.full(7_000, -1.0)
    found[103] = np.r_[np.arange(5_000) * 1e-9, 1e9]
    return found


@pytest.fixture(scope="module")
def table(spark, groups):
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [(7, None), (None, 1.0)]
    np.random.default_rng(1).shuffle(rows)
    return spark.createDataFrame([tuple(r) for r in rows], "k int, v double").repartition(6)


@pytest.mark.parametrize(("big", "many", "bucket"), [(10**6, 10**5, 10**6), (100, 10**5, 10**6), (100, 10**5, 50), (0, 10**5, 20), (100, 2, 50)])
def test_equal_to_numpy_by_every_way(table, groups, monkeypatch, big, many, bucket):
    """All keys sorted; large ones cut; cut again and again; all cut; the limit raised because too many keys are large."""
    for name, value in (("BIG", big), ("MANY", many), ("BUCKET_ROWS", bucket)):
        monkeypatch.setattr(quantiles, name, value)
    got = {(r.k, r.prob): r.q for r in grouped_quantiles(table, ["k"], "v", PROBS).collect()}
    want = {(k, p): float(np.quantile(vs, p)) for k, vs in groups.items() for p in PROBS}
    assert got.keys() == want.keys()
    assert all(got[x] == pytest.approx(want[x], abs=1e-12) for x in want)


@pytest.mark.parametrize("big", [10**6, 100])
def test_rows_with_the_quantiles_of_their_key(table, groups, monkeypatch, big):
    monkeypatch.setattr(quantiles, "BIG", big)
    rows = with_quantiles(table, ["k"], "v", {"lo": 0.25, "hi": 0.75}, F.col("v") > 0).collect()
    assert len(rows) == sum(map(len, groups.values())) + 1  # the row without a value stays, the one without a key goes
    for r in rows:
        wet = [v for v in groups[r.k] if v > 0]
        assert (r.lo, r.hi) == (pytest.approx(tuple(np.quantile(wet, [0.25, 0.75]))) if wet else (None, None))


def test_many_keys_are_placed_once(spark):
    """100,000 keys: one shuffle of the rows by key, and no join of them."""
    df = spark.range(400_000).select((F.col("id") % 100_000).alias("k"), F.rand(3).alias("v"))
    for out in (grouped_quantiles(df, ["k"], "v", [0.5]), with_quantiles(df, ["k"], "v", {"q": 0.5}).groupBy("k").agg(F.max("q"))):
        assert out.count() == 100_000
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan


def test_large_keys_are_not_shuffled(table, monkeypatch):
    monkeypatch.setattr(quantiles, "BIG", 0)
    plan = grouped_quantiles(table, ["k"], "v", [0.5])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_a_key_of_ten_million_rows(spark, monkeypatch):
    """Exact, with no task that sorts more than a bucket."""
    monkeypatch.setattr(quantiles, "BUCKET_ROWS", 5_000)
    n = 10_000_000
    df = spark.range(n).select(F.lit(1).alias("k"), (F.col("id") * 7_368_787 % n).cast("double").alias("v"))
    got = {r.prob: r.q for r in grouped_quantiles(df, ["k"], "v", [0.1, 0.5]).collect()}
    assert got == {p: pytest.approx(p * (n - 1)) for p in (0.1, 0.5)}


def test_no_rows(spark):
    empty = spark.createDataFrame([], "k int, v double")
    assert grouped_quantiles(empty, ["k"], "v", [0.5]).count() == 0
    assert with_quantiles(empty, ["k"], "v", {"q": 0.5}).count() == 0
