"""From predictions to a stored verification table and its breakdowns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from gridspark.columns import CELL
from gridspark.operators.align import align_fcst_ref
from gridspark.operators.evaluate import mean_std, score_breakdown, score_by_hour, score_map
from gridspark.operators.scores import score


def verification_table(fcst: DataFrame, ref: DataFrame, path: str, time: str = "time",
                       value: str = "value") -> DataFrame:
    """Forecast next to reference, written once; every score then reads the stored table."""
    spark: SparkSession = fcst.sparkSession
    align_fcst_ref(fcst, ref, (time, *CELL), value).write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def evaluate(table: DataFrame, names: Sequence[str], time: str = "time", **options) -> dict[str, dict[str, DataFrame]]:
    """Per score: value per time, overall mean and spread, by hour, by season and hour; and the map over time."""
    out: dict[str, dict[str, DataFrame]] = {"map": {"all": score_map(table, time=time)}}
    for name in names:
        per_time = score(table, name, [time], **options.get(name, {}))
        out[name] = {"per_time": per_time, "summary": mean_std(per_time, name),
                     "by_hour": score_by_hour(per_time, name, time), "breakdown": score_breakdown(per_time, name, time)}
    return out
