"""Event counts at a threshold and the scores made of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.1


def event_counts(df: DataFrame, thresh: float = THRESHOLD, by: Sequence[str] = (), fcst: str = "fcst",
                 ref: str = "ref_") -> DataFrame:
    """Hits a, false alarms b, misses c and correct rejections d; a pair with a missing side counts nowhere."""
    f, r = F.col(fcst), F.col(ref)
    return df.groupBy(*by).agg(
        F.count_if((f >= thresh) & (r >= thresh)).alias("a"), F.count_if((f >= thresh) & (r < thresh)).alias("b"),
        F.count_if((f < thresh) & (r >= thresh)).alias("c"), F.count_if((f < thresh) & (r < thresh)).alias("d"))


def _ratio(num: Column, denom: Column) -> Column:
    return F.when(denom > 0, F.try_divide(num, denom))


def _counts() -> list[Column]:
    return [F.col(c).cast("double") for c in "abcd"]


def ets_of() -> Column:
    a, b, c, d = _counts()
    random_hits = F.try_divide((a + b) * (a + c), a + b + c + d)
    return _ratio(a - random_hits, a + b + c - random_hits)


def fbi_of() -> Column:
    a, b, c, _ = _counts()
    return _ratio(a + b, a + c)


def pss_of() -> Column:
    a, b, c, d = _counts()
    return _ratio(a * d - b * c, (a + c) * (b + d))


def _score(name: str, value):
    def compute(df: DataFrame, by: Sequence[str] = (), thresh: float = THRESHOLD, **kw) -> DataFrame:
        return event_counts(df, thresh, by, **kw).select(*by, value().alias(name))
    return compute


ets = _score("ets", ets_of)
fbi = _score("fbi", fbi_of)
pss = _score("pss", pss_of)
