"""From a stored data set to batches for training or validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from gridspark.operators.normalize import zscore_normalize, zscore_stats
from gridspark.operators.reshape import cast_float32, select_vars
from gridspark.operators.samples import minibatch
from gridspark.session import stored


def prepare_samples(df: DataFrame, mode: str, predictors: Sequence[str], predictands: Sequence[str],
                    batch_size: int, group: str = "group_id", stats: DataFrame | None = None, seed: int = 42,
                    time: str = "time", drop_remainder: bool = False):
    """Normalised 32-bit samples with their batch numbers, and the statistics used.

    Training data give their own statistics; validation and test data must be given those of training.
    """
    if mode not in ("train", "val", "test"):
        raise ValueError(f"unknown mode '{mode}', known: train, val, test")
    if mode != "train" and stats is None:
        raise ValueError(f"mode '{mode}' needs the statistics of the training data")
    variables = [*predictors, *predictands]
    chosen = select_vars(df, variables, keys=(group, time, "iy", "ix"))
    stats = zscore_stats(chosen, variables) if stats is None else stats
    normal = cast_float32(zscore_normalize(chosen, variables, stats), variables)
    batches = minibatch(df.select(group, time).distinct(), batch_size, seed, group, time,
                        drop_remainder=drop_remainder)
    return normal.join(stored(batches, "batches"), [group, time]), stats
