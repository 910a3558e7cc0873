"""Row numbers over a whole table without sorting it in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.functions.draws import hash_bucket, seeded_hash
from gridspark.session import stored


def row_numbers(df: DataFrame, bucket: Column, order: Sequence[Column], keys: Sequence[str] = (),
                out: str = "rn") -> DataFrame:
    """1-based row numbers per ``keys`` (none: the whole table) in the order of ``order``.

    ``bucket`` must grow with ``order``.  Rows are sorted inside their bucket only; where a bucket starts is
    known from the bucket counts, so no task sees more than one bucket of rows or one row per bucket.
    """
    keyed = df.withColumn("_bucket", bucket)
    counts = keyed.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order))
    ranked = keyed.withColumn("_inside", inside).join(starts, [*keys, "_bucket"])
    return ranked.select(*df.columns, (F.col("_start") + F.col("_inside")).alias(out))


def time_ranks(df: DataFrame, time: str = "time", keys: Sequence[str] = (), out: str = "rn") -> DataFrame:
    """Row numbers in time order, bucketed by calendar month (or by 4096 steps of an integer axis)."""
    kind = dict(df.dtypes)[time]
    bucket = F.date_trunc("month", time) if kind.startswith(("timestamp", "date")) else F.floor(F.col(time) / 4096)
    return row_numbers(df, bucket, [F.col(time)], keys, out)


def shuffled_ranks(df: DataFrame, seed: int | str, on: Sequence[str], keys: Sequence[str] = (),
                   out: str = "rn", salt: Sequence[Column] = ()) -> DataFrame:
    """Row numbers in an order drawn from the seed; ``on`` identifies a row."""
    hashed = df.withColumn("_hash", seeded_hash(seed, *salt, *[F.col(c) for c in on]))
    ranked = row_numbers(hashed, hash_bucket(F.col("_hash")), [F.col("_hash"), *[F.col(c) for c in on]], keys, out)
    return ranked.drop("_hash")


# Rows that a task sorts for running sums.
RANGE_ROWS = 100_000


def running_sums(df: DataFrame, order: Sequence[Column], sums: dict[str, Column], rows_per_task: int = RANGE_ROWS) -> DataFrame:
    """The rows with sums over all rows up to each one in the order of ``order``, which must tell all rows apart.

    The rows are dealt out in ranges of the order and stored; what lies before a range is known from the sums of the ranges, so a
    task sorts one range, however many rows there are.  The rows are counted and stored at the call.
    """
    n = max(1, -(-df.count() // rows_per_task))
    ranged = stored(df.withColumns({f"_x_{c}": x for c, x in sums.items()}).repartitionByRange(n, *order).withColumn(
        "_range", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy("_range").agg(*[F.sum(f"_x_{c}").alias(f"_t_{c}") for c in sums])
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    before = totals.select("_range", *[F.coalesce(F.sum(f"_t_{c}").over(earlier), F.lit(0)).alias(f"_b_{c}") for c in sums])
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = ranged.join(F.broadcast(before), "_range")
    return met.select(*df.columns, *[(F.col(f"_b_{c}") + F.sum(f"_x_{c}").over(inside)).alias(c) for c in sums])


def count_up(df: DataFrame, n: Column, out: str, chunk: int = 10_000) -> DataFrame:
    """One row per integer ``0 .. n-1`` of each row, without ever holding all of them in one array."""
    last = (n - 1).cast("bigint")
    parts = df.withColumn("_last", last).where(F.col("_last") >= 0).withColumn(
        "_from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_last"), F.lit(chunk).cast("bigint"))))
    until = F.least(F.col("_from") + chunk - 1, F.col("_last"))
    return parts.withColumn(out, F.explode(F.sequence(F.col("_from"), until))).drop("_last", "_from")
