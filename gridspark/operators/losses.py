"""Training losses over channels and vectors, on columns of targets and predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Pairs = Sequence[tuple[str, str]]


def _errors(pairs: Pairs) -> list[Column]:
    return [F.col(x) - F.col(y) for x, y in pairs]


def loss_channels(df: DataFrame, pairs: Pairs, squared: bool = False, average: bool = False,
                  by: Sequence[str] = ()) -> DataFrame:
    """Sum (or mean) over the channels of the mean absolute or squared error of each."""
    parts = [F.avg(d * d if squared else F.abs(d)) for d in _errors(pairs)]
    total = sum(parts[1:], parts[0])
    return df.groupBy(*by).agg((total / len(parts) if average else total).alias("loss"))


def loss_vector(df: DataFrame, pairs: Pairs, n_vector: int | None = None, squared: bool = False,
                average: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """Mean length (or squared length) of the error vector of the first channels, plus the channel loss of
    the remaining ones."""
    n = len(pairs) if n_vector is None else n_vector
    squares = [d * d for d in _errors(pairs[:n])]
    length2 = sum(squares[1:], squares[0])
    total = F.avg(length2 if squared else F.sqrt(length2))
    rest = [F.avg(d * d if squared else F.abs(d)) for d in _errors(pairs[n:])]
    if rest:
        more = sum(rest[1:], rest[0])
        total = total + (more / len(rest) if average else more)
    return df.groupBy(*by).agg(total.alias("loss"))
