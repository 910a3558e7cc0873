"""Error scores of a forecast against a reference, and the registry that finds them by name."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.columns import CELL, require
from gridspark.operators import contingency, distribution, gradient, seeps


def _diff(fcst: str, ref: str) -> Column:
    return F.col(fcst) - F.col(ref)


def bias(fcst: str = "fcst", ref: str = "ref_") -> Column:
    return F.avg(_diff(fcst, ref))


def mae(fcst: str = "fcst", ref: str = "ref_") -> Column:
    return F.avg(F.abs(_diff(fcst, ref)))


def mse(fcst: str = "fcst", ref: str = "ref_") -> Column:
    return F.avg(_diff(fcst, ref) * _diff(fcst, ref))


def rmse(fcst: str = "fcst", ref: str = "ref_") -> Column:
    return F.sqrt(mse(fcst, ref))


AGGREGATES: dict[str, Callable[..., Column]] = {"bias": bias, "mae": mae, "mse": mse, "rmse": rmse}


def scores_by(df: DataFrame, names: Sequence[str], by: Sequence[str] = (), fcst: str = "fcst",
              ref: str = "ref_") -> DataFrame:
    """Several averaging scores in one pass, one column each."""
    return df.groupBy(*by).agg(*[AGGREGATES[n](fcst, ref).alias(n) for n in names])


def _norm(df: DataFrame, error: Column, avg_dims: Sequence[str], name: str, by: Sequence[str]) -> DataFrame:
    require(df, [*avg_dims, *by])
    sizes = [F.count_distinct(d).alias(f"_n_{d}") for d in avg_dims]
    total = df.groupBy(*by).agg(F.sum(error).alias("_total"), *sizes)
    points = F.lit(1.0)
    for d in avg_dims:
        points = points * F.col(f"_n_{d}")
    return total.select(*by, F.try_divide(F.col("_total"), points).alias(name))


def l1(df: DataFrame, avg_dims: Sequence[str], fcst: str = "fcst", ref: str = "ref_", by: Sequence[str] = ()) -> DataFrame:
    """Sum of absolute errors per ``by``, divided by the number of points of the averaging dimensions in it."""
    return _norm(df, F.abs(_diff(fcst, ref)), avg_dims, "l1", by)


def l2(df: DataFrame, avg_dims: Sequence[str], fcst: str = "fcst", ref: str = "ref_", by: Sequence[str] = ()) -> DataFrame:
    return _norm(df, _diff(fcst, ref) * _diff(fcst, ref), avg_dims, "l2", by)


def psnr(df: DataFrame, by: Sequence[str] = (), pixel_max: float = 1.0, fcst: str = "fcst",
         ref: str = "ref_") -> DataFrame:
    """Peak signal-to-noise ratio; 100 everywhere if the forecast is perfect everywhere."""
    errors = df.groupBy(*by).agg(mse(fcst, ref).alias("mse"))
    perfect = errors.agg(F.max("mse")).scalar() == 0
    ratio = (F.when(perfect, 100.0).when(F.col("mse") == 0, float("inf"))
             .when(F.col("mse").isNotNull(), 20 * F.log10(pixel_max / F.sqrt("mse"))))
    return errors.select(*by, ratio.alias("psnr"))


def acc(df: DataFrame, by: Sequence[str] = (), each: Sequence[str] = ("time",), variant: str = "textbook",
        fcst: str = "fcst_ano", ref: str = "ref__ano") -> DataFrame:
    """Anomaly correlation over space for each ``each``, then its mean per ``by``.

    ``variant='as_written'`` divides by the root of the product of the plain anomaly sums instead.
    """
    f, o = F.col(fcst), F.col(ref)
    both = f.isNotNull() & o.isNotNull()
    if variant == "as_written":
        inside = F.sum(f) * F.sum(o)
    elif variant == "textbook":
        inside = F.sum(F.when(both, f * f)) * F.sum(F.when(both, o * o))
    else:
        raise ValueError(f"unknown variant '{variant}', known: textbook, as_written")
    keys = list(dict.fromkeys([*by, *each]))
    single = df.groupBy(*keys).agg(F.sum(f * o).alias("_fo"), inside.alias("_in"))
    value = F.when(F.col("_in") > 0, F.try_divide(F.col("_fo"), F.sqrt("_in")))
    single = single.select(*keys, value.alias("acc"))
    return single if list(by) == keys else single.groupBy(*by).agg(F.avg("acc").alias("acc"))


def _aggregate(name):
    return lambda df, by, **kw: df.groupBy(*by).agg(AGGREGATES[name](**kw).alias(name))


REGISTRY: dict[str, Callable[..., DataFrame]] = {
    **{name: _aggregate(name) for name in AGGREGATES},
    "psnr": psnr,
    "acc": acc,
    "ets": contingency.ets,
    "fbi": contingency.fbi,
    "pss": contingency.pss,
    "l1": lambda df, by=(), avg_dims=("time", *CELL), **kw: l1(df, avg_dims, by=by, **kw),
    "l2": lambda df, by=(), avg_dims=("time", *CELL), **kw: l2(df, avg_dims, by=by, **kw),
    "grad_amplitude": gradient.amplitude_ratio,
    "seeps": lambda df, by=(), params=None, **kw: seeps.seeps(df, params, by, **kw),
    "iqd": lambda df, by=(), **kw: distribution.iqd(df, by=by, **kw),
}


def score(df: DataFrame, name: str, by: Sequence[str] = (), **options) -> DataFrame:
    """A score by name, retained per ``by``; an unknown name is an error that lists the known ones."""
    if name not in REGISTRY:
        raise ValueError(f"unknown score '{name}', known: {', '.join(REGISTRY)}")
    return REGISTRY[name](df, by, **options)
