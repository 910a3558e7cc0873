"""Partitioned Parquet tables of grid data."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.columns import nan_to_null

SUBSETS = ("train", "val", "test")


def write_dataset(df: DataFrame, base: str, dataset: str, augmented: bool = False) -> None:
    """Add a named data set, whose rows carry their ``subset``, to the table under ``base``."""
    name = dataset + ("_augmented" if augmented else "")
    df.withColumn("dataset", F.lit(name)).write.mode("append").partitionBy("dataset", "subset").parquet(base)


def scan_subset(spark: SparkSession, base: str, known: Iterable[str], dataset: str, subset: str,
                augmented: bool = False, augmentable: Iterable[str] = ()) -> DataFrame:
    """One subset of a named data set; partition columns keep all other files unread."""
    if dataset not in set(known):
        raise ValueError(f"unknown data set '{dataset}', known: {', '.join(known)}")
    if subset not in SUBSETS:
        raise ValueError(f"unknown subset '{subset}', known: {', '.join(SUBSETS)}")
    if augmented and dataset not in set(augmentable):
        raise ValueError(f"there is no augmented form of '{dataset}'")
    name = dataset + ("_augmented" if augmented else "")
    rows = spark.read.parquet(base).where((F.col("dataset") == name) & (F.col("subset") == subset))
    return nan_to_null(rows.drop("dataset", "subset"))


def scan_multifile(spark: SparkSession, paths: Sequence[str], columns: Sequence[str] | None = None,
                   base: str | None = None) -> DataFrame:
    """Many files as one table with the chosen columns only."""
    reader = spark.read.option("basePath", base) if base else spark.read
    df = reader.parquet(*paths)
    return nan_to_null(df.select(*columns) if columns else df)


def list_files(spark: SparkSession, folder: str, pattern: str = "*.parquet") -> DataFrame:
    """Names and sizes of the files of a folder, without reading them; none at all is an error."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
             .load(folder).select("path", "length"))
    if files.isEmpty():
        raise FileNotFoundError(f"no files like '{pattern}' under '{folder}'")
    return files


def write_compressed(df: DataFrame, path: str, codec: str = "zstd") -> None:
    df.write.option("compression", codec).parquet(path)


def with_month(df: DataFrame, time: str = "time") -> DataFrame:
    return df.withColumns({"year": F.year(time), "month": F.month(time)})


def write_monthly(df: DataFrame, path: str, time: str = "time", mode: str = "errorifexists") -> None:
    """One directory per year and month.

    Months are rebalanced by their measured size: small ones share a task, a very large one is split.
    """
    (with_month(df, time).hint("rebalance", "year", "month")
     .write.mode(mode).partitionBy("year", "month").parquet(path))


def missing_steps(df: DataFrame, existing: DataFrame, time: str = "time", keys: Sequence[str] = ()) -> DataFrame:
    """Rows whose time step (and further ``keys``) the existing table does not hold yet.

    Only the months that ``df`` has are read of the existing table.  Without ``keys`` a step counts as done when any of its rows
    is there; name the cells as keys where steps may have been written in part.
    """
    rows = with_month(df, time)
    months = rows.select("year", "month").distinct()
    done = existing.join(months, ["year", "month"], "left_semi").select("year", "month", time, *keys).distinct()
    return rows.join(done, ["year", "month", time, *keys], "left_anti").select(*df.columns)


def append_missing(df: DataFrame, path: str, time: str = "time", keys: Sequence[str] = ()) -> None:
    """Write only what is not there, also into months that are there in part; what exists is not touched."""
    existing = df.sparkSession.read.parquet(path)
    write_monthly(missing_steps(df, existing, time, keys), path, time, mode="append")
