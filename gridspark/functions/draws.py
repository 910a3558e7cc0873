"""Random draws that depend on a seed and a key only, never on partitions or retries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RANGE = 1 << 32


def seeded_hash(seed: int | str, *keys: Column) -> Column:
    """A 32-bit integer from the seed and the keys, the same on every executor and attempt."""
    text = F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def draw_below(hashed: Column, n: Column) -> Column:
    """An integer in ``0 .. n-1`` from a 32-bit hash."""
    return F.floor(hashed.cast("double") / RANGE * n).cast("bigint")


def hash_bucket(hashed: Column, bits: int = 10) -> Column:
    """Leading bits of the hash: even, ordered buckets for ranking by hash."""
    return F.shiftright(hashed, 32 - bits)
