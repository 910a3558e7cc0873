"""Distances between distributions and quantiles conditioned on bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.functions.quantiles import wide_quantiles
from gridspark.functions.ranking import count_up

# Integration nodes for precipitation by accumulation hours (one, two to six, more).
NODES_1H = [0.0, 0.005, 0.01, 0.015, 0.025, 0.04, 0.06, 0.08, 0.1, 0.13, 0.16, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6,
            0.8, 1.0, 1.25, 1.5, 1.8, 2.4, 3.0, 3.75, 4.5, 5.25, 6.0, 7.0, 9.0, 12.0, 20.0, 30.0, 50.0]
NODES_6H = [0.0, 0.005, 0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7, 0.9, 1.15, 1.5, 1.9, 2.4,
            3.0, 4.0, 5.0, 6.0, 7.5, 10.0, 15.0, 25.0, 40.0, 60.0]
NODES_LONG = [0.0, 0.01, 0.02, 0.035, 0.05, 0.075, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.75, 1.0, 1.3, 1.7, 2.1, 2.5,
              3.0, 3.5, 4.0, 4.75, 5.5, 6.3, 7.1, 8.0, 9.0, 10.0, 12.5, 15.0, 20.0, 25.0, 35.0, 50.0, 70.0, 100.0]

# The value the distribution should reach at the last node.
FULL_CDF = 0.999


def default_nodes(hours: int = 0) -> list[float]:
    if hours == 1:
        return NODES_1H
    return NODES_6H if 1 < hours <= 6 else NODES_LONG


def node_cdf(df: DataFrame, values: Sequence[str], nodes: Sequence[float], drop_zero: bool = True,
             by: Sequence[str] = ()) -> DataFrame:
    """Empirical distribution of each variable at the nodes: rows ``(by, variable, cdf array)``.

    The distribution is linear between the sorted values, ``rank / (n - 1)`` at each.  Only the count and the
    smallest and largest value between two nodes are needed, so one combined pass gives it without a sort.
    """
    long = df.unpivot(list(by), list(values), "variable", "v").where(F.col("v").isNotNull())
    if drop_zero:
        long = long.where(F.col("v") > 0)
    gap = sum(((F.col("v") > float(x)).cast("int") for x in nodes), F.lit(0))
    gaps = long.groupBy(*by, "variable", gap.alias("gap")).agg(
        F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    # at most one entry per gap between nodes
    arrays = gaps.groupBy(*by, "variable").agg(F.collect_list(F.struct("gap", "n", "lo", "hi")).alias("gaps"))
    total = _total(F.col("gaps"))

    def at(i, x):
        below = F.filter("gaps", lambda g: g["gap"] <= i)
        above = F.filter("gaps", lambda g: g["gap"] > i)
        lo = F.array_max(F.transform(below, lambda g: g["hi"]))
        hi = F.array_min(F.transform(above, lambda g: g["lo"]))
        c = _total(below)
        inner = F.try_divide(c - 1 + F.try_divide(x - lo, hi - lo), total - 1)
        return F.when(total < 2, F.lit(None).cast("double")).when(c == 0, 0.0).when(c == total, 1.0).otherwise(inner)

    return arrays.select(*by, "variable", F.transform(_array(nodes), lambda x, i: at(i, x)).alias("cdf"))


def _array(nodes: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in nodes])


def _total(gaps: Column) -> Column:
    return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda s, g: s + g["n"])


def ecdf_at_nodes(df: DataFrame, values: Sequence[str], nodes: Sequence[float], drop_zero: bool = True) -> DataFrame:
    """The same as rows ``(variable, node, cdf)``."""
    rows = node_cdf(df, values, nodes, drop_zero).select("variable", F.posexplode("cdf").alias("i", "cdf"))
    return rows.select("variable", F.get(_array(nodes), F.col("i")).alias("node"), "cdf")


def iqd(df: DataFrame, nodes: Sequence[float] | None = None, hours: int = 0, drop_zero: bool = True,
        fcst: str = "fcst", ref: str = "ref_", by: Sequence[str] = ()) -> DataFrame:
    """Per ``by`` the integral of the squared difference of the two distributions over the nodes, by the trapezoid rule.

    ``complete`` tells whether both distributions reach 0.999 at the last node; if not, set the nodes.
    """
    xs = [float(x) for x in (default_nodes(hours) if nodes is None else nodes)]
    cdf = node_cdf(df, [fcst, ref], xs, drop_zero, by)
    both = cdf.groupBy(*by).agg(*[F.max(F.when(F.col("variable") == v, F.col("cdf"))).alias(v) for v in (fcst, ref)])
    squares = F.zip_with(ref, fcst, lambda o, f: (o - f) * (o - f))
    both = both.withColumns({"_x": _array(xs), "_d": squares})

    def trapezoid(total, i):
        x, d = F.col("_x"), F.col("_d")
        return total + (F.get(d, i) + F.get(d, i - 1)) / 2 * (F.get(x, i) - F.get(x, i - 1))

    area = F.aggregate(F.sequence(F.lit(1), F.lit(len(xs) - 1)), F.lit(0.0), trapezoid)
    last = F.lit(len(xs) - 1)
    complete = (F.get(F.col(ref), last) >= FULL_CDF) & (F.get(F.col(fcst), last) >= FULL_CDF)
    return both.select(*by, area.alias("iqd"), complete.alias("complete"))


CALIBRATION, LIKELIHOOD = "calibration_refinement", "likelihood-base_rate"


def conditional_quantiles(df: DataFrame, factorization: str = CALIBRATION, quantiles: Sequence[float] = (0.05, 0.5, 0.95),
                          fcst: str = "fcst", ref: str = "ref_") -> DataFrame:
    """Quantiles of one variable where the other lies in unit bins ``[b, b+1)``.

    The panel covers the range of both variables; bins without values are NULL, and so is everything at or
    above the rounded-up maximum of the conditioning variable.
    """
    if factorization not in (CALIBRATION, LIKELIHOOD):
        raise ValueError(f"choose '{CALIBRATION}' or '{LIKELIHOOD}' as factorization")
    return conditional_panels(df, [factorization], quantiles, fcst, ref).drop("factorization")


def conditional_panels(df: DataFrame, factorizations: Sequence[str] = (CALIBRATION, LIKELIHOOD),
                       quantiles: Sequence[float] = (0.05, 0.5, 0.95), fcst: str = "fcst", ref: str = "ref_") -> DataFrame:
    """The same for several factorizations in the same passes over the data, with a column ``factorization``."""
    if len(quantiles) < 3:
        raise ValueError("give at least three quantiles")
    names = {f"q{str(round(q * 100, 6)).rstrip('0').rstrip('.').replace('.', '_').zfill(2)}": q for q in quantiles}
    sides = {CALIBRATION: (fcst, ref), LIKELIHOOD: (ref, fcst)}
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("factorization"), F.floor(sides[f][0]).alias("bin"), F.col(sides[f][1]).alias("_t"))
                                for f in factorizations]))
    binned = df.select(pairs.alias("_p")).select("_p.*").where(F.col("bin").isNotNull())
    per_bin = wide_quantiles(binned, ["factorization", "bin"], "_t", names)
    span = df.agg(F.least(F.floor(F.min(fcst)), F.floor(F.min(ref))).alias("lo"),
                  F.greatest(F.ceil(F.max(fcst)), F.ceil(F.max(ref))).alias("hi"),
                  F.array(*[F.struct(F.lit(f).alias("factorization"), F.ceil(F.max(sides[f][0])).alias("top")) for f in factorizations]).alias("tops"))
    panel = count_up(span.select("lo", "hi", F.inline("tops")), F.col("hi") - F.col("lo"), "_i").select(
        "factorization", (F.col("lo") + F.col("_i")).alias("bin"), "top")
    kept = [F.when(F.col("bin") < F.col("top"), F.col(n)).alias(n) for n in names]
    return panel.join(per_bin, ["factorization", "bin"], "left").select("factorization", (F.col("bin") + 0.5).alias("bin_center"), *kept)
