"""Session set-up and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_HANDED_OUT: dict[str, list[str]] = {}


def build_session(app: str = "gridspark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library relies on; a cluster keeps its own master and sizes."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``, where every executor can reach it.

    Only a local master may fall back to a folder of this machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        base = tempfile.mkdtemp(prefix="gridspark-")
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _HANDED_OUT.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release_scratch(spark: SparkSession) -> int:
    """Delete the folders handed out in this application so far; returns their number.

    To be called when no table that was read from them is needed any more.
    """
    paths = _HANDED_OUT.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return len(paths)


def tasks_for(df: DataFrame, rows: int) -> int:
    """How many tasks share a table: one for so many rows, but not fewer than run at a time.

    For small rows that turn into much more, where the size of what is read or shuffled tells too little.
    """
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // max(rows, 1)))


def stored(df: DataFrame, label: str) -> DataFrame:
    """A derived side table, written to the shared folder and read back.

    For tables that are much smaller than the data they come from: they are computed once, outlive lost
    executors, and their size is known when the join with the data is planned, so that Spark sends them to
    the executors if they are small and shuffles both sides only if they are not.
    """
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
