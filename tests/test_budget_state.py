"""The error budget of a stream keeps a small state instead of reading what earlier steps counted."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gridspark.streaming import ingest

START = dt.datetime(2021, 1, 1)


def files(spark, path, n, failing=(), first=0):
    for i in range(first, first + n):
        rows = [(START + dt.timedelta(days=i), float(-1 if i in failing and k == 0 else k)) for k in range(3)]
        spark.createDataFrame(rows, "time timestamp_ntz, v double").coalesce(1).write.mode("append").parquet(path)


def run(spark, base, name, **kw):
    schema = "time timestamp_ntz, v double"
    ingest.stream_with_budget(spark, f"{base}/in", schema, F.col("v") < 0, f"{base}/out", f"{base}/{name}", **kw).awaitTermination()


def state(spark, base):
    return ingest._steps(spark, f"{base}/out_failed_pieces")


def test_what_a_step_reads_stays_the_same(spark, tmp_path, monkeypatch):
    base, read = str(tmp_path), []
    files(spark, f"{base}/in", 14, failing={2, 5, 9})
    original = ingest.failed_before

    def watched(session, path, own, step, per_run):
        found = original(session, path, own, step, per_run)
        read.append(0 if found is None else len(found.inputFiles()))
        return found

    monkeypatch.setattr(ingest, "failed_before", watched)
    run(spark, base, "c", max_warn=3)
    assert len(read) == 14 and max(read) == 1
    (steps,) = state(spark, base).values()
    assert steps == [12, 13]
    assert spark.read.parquet(f"{base}/out").count() == 14 * 3 - 3
    last = ingest.failed_before(spark, f"{base}/out_failed_pieces", "another", 0, False)
    assert sorted(r.time for r in last.collect()) == [START + dt.timedelta(days=d) for d in (2, 5, 9)]


def test_the_budget_of_all_runs_and_of_one(spark, tmp_path):
    base = str(tmp_path)
    files(spark, f"{base}/in", 3, failing={0, 1})
    run(spark, base, "c1", max_warn=2)
    run(spark, base, "c2", max_warn=2)  # the same pieces fail again and count once
    files(spark, f"{base}/in", 1, failing={3}, first=3)
    with pytest.raises(Exception, match="3 pieces have failed rows"):
        run(spark, base, "c1", max_warn=2)
    # a run of its own takes what is new
    files(spark, f"{base}/more", 1)
    ingest.stream_with_budget(spark, f"{base}/more", "time timestamp_ntz, v double", F.col("v") < 0, f"{base}/out", f"{base}/c3", max_warn=0,
                              per_run=True).awaitTermination()
    assert len(state(spark, base)) == 3


def test_a_step_that_is_run_again(spark, tmp_path):
    base = str(tmp_path)
    files(spark, f"{base}/in", 2, failing={0, 1})
    with pytest.raises(Exception, match="2 pieces have failed rows, 1 are tolerated"):
        run(spark, base, "c", max_warn=1)
    run(spark, base, "c", max_warn=2)
    assert spark.read.parquet(f"{base}/out").count() == 4
    assert spark.read.parquet(f"{base}/out_failed").where("n_bad > 0").count() == 2
