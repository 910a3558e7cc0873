"""File streams with frozen statistics and an error budget."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridspark.operators.normalize import normalized, stats_columns
from gridspark.session import stored
from gridspark.sources.tables import with_month

MAX_WARN = 3


def stream_normalize(spark: SparkSession, source: str, schema, stats: DataFrame, variables: Sequence[str], sink: str,
                     checkpoint: str, files_per_step: int = 1, time: str = "time",
                     available_now: bool = True) -> StreamingQuery:
    """Normalise files as they arrive and append them to a monthly table as 32-bit floats.

    The statistics are those of the training data and do not change while the stream runs.  The checkpoint
    records which files are done, so a restarted stream takes up where it stopped.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_step).parquet(source)
    # one row of statistics, computed now: each step reads the stored row, not the training data
    wide = stored(stats_columns(stats, variables), "statistics").withColumn("_one", F.lit(1))
    joined = stream.withColumn("_one", F.lit(1)).join(F.broadcast(wide), "_one")
    cols = {v: normalized(F.col(v), F.col(f"mu_{v}"), F.col(f"sigma_{v}")).cast("float") for v in variables}
    keys = [c for c in stream.columns if c not in variables]
    out = with_month(joined.withColumns(cols).select(*keys, *variables), time)
    writer = (out.writeStream.format("parquet").partitionBy("year", "month").outputMode("append")
              .option("path", sink).option("checkpointLocation", checkpoint))
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def _verdict(bad: Column) -> Column:
    """A row whose check has no answer has failed it."""
    return F.coalesce(bad, F.lit(True))


def bad_per_month(df: DataFrame, bad: Column, time: str = "time") -> DataFrame:
    """Failed and good rows per month."""
    failed = _verdict(bad)
    return with_month(df, time).groupBy("year", "month").agg(
        F.count_if(failed).alias("n_bad"), F.count_if(~failed).alias("n_good"))


def bad_per_piece(df: DataFrame, bad: Column, pieces: Sequence[str] = ("time",)) -> DataFrame:
    """Failed and good rows per piece, by default a time step."""
    failed = _verdict(bad)
    return df.groupBy(*pieces).agg(F.count_if(failed).alias("n_bad"), F.count_if(~failed).alias("n_good"))


def _check_budget(failed: int, max_warn: int) -> None:
    if failed > max_warn:
        raise ValueError(f"{failed} pieces have failed rows, {max_warn} are tolerated")


def error_budget(df: DataFrame, bad: Column, max_warn: int = MAX_WARN, pieces: Sequence[str] = ("time",)) -> DataFrame:
    """The good rows; more than ``max_warn`` pieces with failed rows end the job with an error."""
    _check_budget(bad_per_piece(df, bad, pieces).where("n_bad > 0").count(), max_warn)
    return df.where(~_verdict(bad))


def _folder(spark: SparkSession, path: str):
    """A folder as Hadoop sees it, with its file system."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _steps(spark: SparkSession, path: str) -> dict[str, list[int]]:
    """Runs and their steps that a state folder holds."""
    place, fs = _folder(spark, path)
    if not fs.exists(place):
        return {}
    found: dict[str, list[int]] = {}
    for run in fs.listStatus(place):
        name = run.getPath().getName()
        if name.startswith("run="):
            inside = [x.getPath().getName() for x in fs.listStatus(run.getPath())]
            found[name[4:]] = sorted(int(x[5:]) for x in inside if x.startswith("step="))
    return found


def failed_before(spark: SparkSession, state: str, run: str, step: int, per_run: bool) -> DataFrame | None:
    """The pieces that failed before this step of this run, and in the other runs unless the budget is one run's."""
    paths = []
    for other, steps in _steps(spark, state).items():
        known = [s for s in steps if other != run or s < step]
        if known and (other == run or not per_run):
            paths.append(f"{state}/run={other}/step={known[-1]}")
    return spark.read.parquet(*paths) if paths else None


def forget_before(spark: SparkSession, state: str, run: str, step: int) -> None:
    """Drop the states that later steps replace; the one before stays, for a step that is run again."""
    for old in [s for s in _steps(spark, state).get(run, []) if s < step - 1]:
        place, fs = _folder(spark, f"{state}/run={run}/step={old}")
        fs.delete(place, True)


def stream_with_budget(spark: SparkSession, source: str, schema, bad: Column, sink: str, checkpoint: str,
                       max_warn: int = MAX_WARN, files_per_step: int = 1, pieces: Sequence[str] = ("time",),
                       per_run: bool = False) -> StreamingQuery:
    """Stream good rows to the sink; the counts of failed rows lie next to it in ``<sink>_failed``.

    Both are partitioned by run and step.  The run is the id that the checkpoint gives its query, so a step that is run again
    replaces what it wrote, and a stream with a checkpoint of its own adds to what others have written.  The budget covers all
    runs, or with ``per_run`` each one by itself; a piece that fails in several steps counts once.

    The different pieces that have failed so far, of which a running stream has ``max_warn`` at the most, are kept in
    ``<sink>_failed_pieces``.  A step reads them and its own rows, never the counts of earlier steps, so its cost stays the same.
    """
    counts, state = f"{sink}_failed", f"{sink}_failed_pieces"

    def step(batch: DataFrame, batch_id: int) -> None:
        run = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        if not run:
            raise RuntimeError("a step must know the id of its query")
        place = {"run": F.lit(run), "step": F.lit(batch_id)}

        def put(rows: DataFrame, path: str) -> None:
            (rows.withColumns(place).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("run", "step").parquet(path))

        put(bad_per_piece(batch, bad, pieces), counts)
        here, fs = _folder(spark, f"{counts}/run={run}/step={batch_id}")
        own = spark.read.parquet(here.toString()) if fs.exists(here) else bad_per_piece(batch, bad, pieces)  # none for no rows
        failed = own.where("n_bad > 0").select(*pieces)
        earlier = failed_before(spark, state, run, batch_id, per_run)
        known = (failed if earlier is None else failed.unionByName(earlier)).distinct()
        _check_budget(known.count(), max_warn)
        known.coalesce(1).write.mode("overwrite").parquet(f"{state}/run={run}/step={batch_id}")
        put(batch.where(~_verdict(bad)), sink)
        forget_before(spark, state, run, batch_id)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_step).parquet(source)
    return (stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
