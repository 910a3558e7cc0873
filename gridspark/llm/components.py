"""Connected components of links between integer ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.session import stored


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """Each id hands its smallest neighbour to its larger neighbours, or to its smaller ones and itself."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")) if large else both.groupBy("a").agg(F.min("b").alias("m"))
    met = both.join(least, "a")
    if large:
        out = met.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                                           F.struct("a", F.col("m").alias("b")))).alias("x")).select("x.*")
    return out.where(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node`` and ``component``, the smallest id reachable, of every id in the links ``a``, ``b``.

    Large and small stars alternate until the links no longer change: a number of rounds that grows with the logarithm of the
    number of ids.  Each round is written to the shared folder; the driver sees a count and a checksum only.
    """
    now = stored(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = _mark(now)
    for _ in range(most_rounds):
        if mark[0] == 0:
            break
        # after the large star each id points to a smaller one
        now = stored(_stars(_stars(now, True), False), "links")
        then, mark = mark, _mark(now)
        if then == mark:
            break
    else:
        raise RuntimeError(f"components are not settled after {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _mark(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b") % 1_000_003), F.lit(0))).first()
    return int(row[0]), int(row[1])
