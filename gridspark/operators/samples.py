"""Samples for training: file groups, padding, shuffled batches, epochs, shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.functions.draws import draw_below, hash_bucket, seeded_hash
from gridspark.functions.ranking import count_up, row_numbers, shuffled_ranks, time_ranks
from gridspark.session import stored


def closest_divisor(n: Column, wanted: int) -> Column:
    """The divisor of ``n`` nearest to the wanted one, the smaller of two."""
    root = F.floor(F.sqrt(n.cast("double")))
    small = F.filter(F.sequence(F.lit(1).cast("bigint"), root), lambda d: n % d == 0)
    divisors = F.concat(small, F.transform(small, lambda d: F.floor(n / d)))
    best = F.array_min(F.transform(divisors, lambda d: F.struct(F.abs(d - wanted).alias("gap"), d.alias("d"))))
    return best["d"]


def file_groups(files: DataFrame, wanted: int, seed: int = 42, on: str = "month") -> DataFrame:
    """Files in random order, cut into equal groups whose size divides the number of files."""
    ranked = shuffled_ranks(files.select(on).distinct(), seed, [on])
    counted = ranked.agg(F.count(F.lit(1)).alias("n"))
    size = counted.select(closest_divisor(F.col("n"), wanted).alias("size")).scalar()
    return ranked.withColumn("group_size", size).select(
        on, F.floor((F.col("rn") - 1) / F.col("group_size")).alias("group_id"), "rn", "group_size")


def pad_groups(samples: DataFrame, group: str = "group_id", time: str = "time", seed: int = 42,
               step: str = "interval 1 day") -> DataFrame:
    """Fill every group up to the size of the largest with a contiguous slice of its own samples.

    The copies get times that continue after the group's last one and ``padded = true``; ``source_time`` says
    where their data come from.  A group too small for one slice is gone through again from its start.
    """
    ranked = time_ranks(samples.select(group, time).distinct(), time, [group])
    sizes = ranked.groupBy(group).agg(F.max("rn").alias("n"), F.max(time).alias("last"))
    missing = (sizes.withColumn("full", sizes.agg(F.max("n")).scalar())
               .withColumn("missing", F.col("full") - F.col("n")).where(F.col("missing") > 0))
    room = F.greatest(F.col("n") - F.col("missing"), F.lit(0)) + 1
    start = draw_below(seeded_hash(seed, F.col(group)), room)
    slots = (count_up(missing.withColumn("start", start), F.col("missing"), "j")
             .withColumn("rn", (F.col("start") + F.col("j")) % F.col("n") + 1))
    copies = slots.join(ranked.withColumnRenamed(time, "source_time"), [group, "rn"]).select(
        group, (F.col("last") + F.expr(step) * (F.col("j") + 1)).cast("timestamp_ntz").alias(time),
        F.lit(True).alias("padded"), "source_time")
    own = ranked.select(group, time, F.lit(False).alias("padded"), F.col(time).alias("source_time"))
    return own.unionByName(copies)


def minibatch(samples: DataFrame, batch_size: int, seed: int = 42, group: str = "group_id", time: str = "time",
              d_steps: int = 0, drop_remainder: bool = False) -> DataFrame:
    """Shuffle the samples of each group and cut them into batches.

    For multi-step training a batch holds ``d_steps + 1`` sub-batches of the given size.
    """
    size = batch_size * (d_steps + 1)
    ranked = shuffled_ranks(samples, seed, [time], [group], salt=[F.col(group)])
    at = F.col("rn") - 1
    out = ranked.withColumns({"batch_id": F.floor(at / size), "sub_step": F.floor(at % size / batch_size)})
    if drop_remainder:
        whole = ranked.groupBy(group).agg(F.floor(F.count(F.lit(1)) / size).alias("_whole"))
        out = out.join(whole, group).where(F.col("batch_id") < F.col("_whole")).drop("_whole")
    return out.drop("rn")


def epochs(samples: DataFrame, nepochs: int, seed: int = 42, time: str = "time", group: str = "group_id") -> DataFrame:
    """Repeat the samples per epoch, in a new order each time: ``step`` is the position in the epoch."""
    repeated = samples.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(nepochs - 1))))
    hashed = repeated.withColumn("_hash", seeded_hash(seed, F.col("epoch"), F.col(group), F.col(time)))
    ranked = row_numbers(hashed, hash_bucket(F.col("_hash")), [F.col("_hash"), F.col(time)], ["epoch", group], "step")
    return ranked.drop("_hash")


def epoch_group(step: Column, n_groups: int) -> Column:
    """The group to load at a step of an endless stream of groups."""
    return F.pmod(step, F.lit(n_groups))


def shard(df: DataFrame, rank: int, size: int, time: str = "time") -> DataFrame:
    """Every ``size``-th time step, starting with number ``rank``."""
    if not 0 <= rank < size:
        raise ValueError(f"rank {rank} is not below size {size}")
    mine = time_ranks(df.select(time).distinct(), time).where(F.pmod(F.col("rn") - 1, F.lit(size)) == rank)
    return df.join(stored(mine.select(time), "shard-times"), time, "left_semi")
