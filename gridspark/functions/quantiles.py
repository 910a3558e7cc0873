"""Exact quantiles for any number of keys and any size of a key.

Rows of a key are counted first.  Keys of up to ``BIG`` rows, however many, are placed once by their key and sorted there.  Larger
keys, of which there are few, are never shuffled: a bounded sketch cuts their values into ordered buckets, exact counts per bucket
tell which ones hold the wanted ranks, and those are cut again until each holds few enough values to be sorted.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.session import stored

ACCURACY = 2000
EVEN_CUTS = 16
# Distances from a wanted probability at which the values are cut, too.
NEAR = (0.002, 0.02)
# Rows that a key may have to be sorted as a whole in one task; and how many keys may have more, beyond which the limit rises.
BIG, MANY = 1_000_000, 100_000
# Rows of a bucket beyond which it is cut again, into so many parts.
BUCKET_ROWS, PARTS = 1_000_000, 64


def _cut_points(probs: Sequence[float]) -> list[float]:
    near = {p + s * d for p in probs for d in NEAR for s in (-1, 1)}
    even = {i / EVEN_CUTS for i in range(1, EVEN_CUTS)}
    return sorted(p for p in near | even if 0 < p < 1)


def _sketch(cuts: Sequence[float]) -> Column:
    listed = ", ".join(f"{c!r}D" for c in cuts)
    return F.expr(f"array_distinct(percentile_approx(_v, array({listed}), {ACCURACY}))").alias("_cuts")


def _valued(df: DataFrame, keyed: Sequence[str], value: str) -> Column:
    return reduce(and_, [F.col(c).isNotNull() for c in [*keyed, value]])


def _large_keys(rows: DataFrame, keyed: Sequence[str]) -> tuple[DataFrame | None, bool]:
    """The keys with too many rows to be sorted in one task, if there are any, and whether there are others."""
    sizes = stored(rows.groupBy(*keyed).agg(F.count(F.lit(1)).alias("_n")), "key-sizes")
    n, n_large = sizes.agg(F.count(F.lit(1)), F.count_if(F.col("_n") > BIG)).first()
    if not n_large:
        return None, True
    limit = BIG
    if n_large > MANY:
        limit = sizes.orderBy(F.desc("_n")).offset(MANY).select("_n").first()["_n"]
    return stored(sizes.where(F.col("_n") > limit).select(*keyed), "large-keys"), n > n_large or limit > BIG


def _ranks(probs: Sequence[float], total: str) -> str:
    return ", ".join(f"struct({float(p)!r}D AS prob, {float(p)!r}D * ({total} - 1) AS pos)" for p in probs)


def _picked(ranked: DataFrame, keyed: Sequence[str], low: str, high: str) -> DataFrame:
    """The interpolated value of each wanted probability from the rows at the two ranks around it."""
    found = ranked.groupBy(*keyed, "prob").agg(
        F.expr(f"max(CASE WHEN {low} THEN _v END)").alias("_lo"),
        F.expr(f"max(CASE WHEN {high} THEN _v END)").alias("_hi"), F.expr("max(pos - floor(pos))").alias("_t"))
    return found.selectExpr(*keyed, "prob", "_lo + (_hi - _lo) * _t AS q")


def _sorted_keys(rows: DataFrame, keyed: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Quantiles of keys that fit into a task: one shuffle by key, whose order gives the ranks."""
    inside = Window.partitionBy(*keyed)
    ranked = rows.withColumns({"_rank": F.row_number().over(inside.orderBy("_v")) - 1, "_total": F.count(F.lit(1)).over(inside)})
    at = ranked.selectExpr(*keyed, "_v", "_rank", f"inline(filter(array({_ranks(probs, '_total')}), "
                           "w -> floor(w.pos) = _rank OR ceil(w.pos) = _rank))")
    return _picked(at, keyed, "floor(pos) = _rank", "ceil(pos) = _rank")


IN_BUCKET = "(_above IS NULL OR _v > _above) AND (_upto IS NULL OR _v <= _upto)"


def _wanted_parts(sizes: DataFrame, cut: DataFrame, on: Sequence[str], start: str) -> DataFrame:
    """Of counted parts those that hold a wanted rank, with their bounds and the rank they start at."""
    before = Window.partitionBy(*on).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).join(cut, list(on))
    keys = [c for c in on if c != "_b"]
    return placed.selectExpr(
        *keys, f"_b * {PARTS} + _part AS _b", "coalesce(get(_cuts, _part - 1), _above) AS _above", "coalesce(get(_cuts, _part), _upto) AS _upto",
        f"{start} + _before AS _start", "_rows", "_rows = _size AS _same", "_want").selectExpr(
        *keys, "_b", "_above", "_upto", "_start", "_rows", "_same",
        "filter(_want, w -> ceil(w.pos) >= _start AND floor(w.pos) < _start + _rows) AS _want").where("size(_want) > 0")


def _cut_keys(rows: DataFrame, keyed: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Quantiles of keys of any size, whose rows are read several times but not shuffled."""
    sketch = rows.groupBy(*keyed).agg(_sketch(_cut_points(probs)), F.count(F.lit(1)).alias("_size"))
    sketch = stored(sketch.selectExpr("*", f"array({_ranks(probs, '_size')}) AS _want", "CAST(NULL AS DOUBLE) AS _above",
                                      "CAST(NULL AS DOUBLE) AS _upto", "0L AS _b", "0L AS _start"), "sketch")
    part = F.expr("size(filter(_cuts, c -> c < _v))").alias("_part")

    def counted(cut: DataFrame, on: Sequence[str]) -> DataFrame:
        met = rows.join(cut.select(*on, "_cuts", "_above", "_upto"), list(keyed)).where(IN_BUCKET)
        return met.groupBy(*on, part).agg(F.count(F.lit(1)).alias("_rows"))

    on = [*keyed, "_b"]
    buckets = stored(_wanted_parts(counted(sketch, on), sketch, on, "_start"), "buckets")
    done = []
    # a bucket that a cut leaves as it is holds one value, which is counted and not sorted
    large = (F.col("_rows") > BUCKET_ROWS) & ~F.col("_same")
    while not buckets.where(large).isEmpty():
        done.append(buckets.where(~large))
        again = buckets.where(large).withColumnRenamed("_rows", "_size").drop("_same")
        met = rows.join(again.select(*on, "_above", "_upto"), list(keyed)).where(IN_BUCKET)
        cuts = met.groupBy(*on).agg(_sketch([i / PARTS for i in range(1, PARTS)]))
        cut = stored(again.join(cuts, on), "sketch")
        buckets = stored(_wanted_parts(counted(cut, on), cut, on, "_start"), "buckets")
    buckets = reduce(DataFrame.unionByName, [*done, buckets])

    counts = (rows.join(buckets.select(*on, "_above", "_upto"), list(keyed)).where(IN_BUCKET)
              .groupBy(*on, "_v").agg(F.count(F.lit(1)).alias("_n")))
    so_far = Window.partitionBy(*on).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (counts.join(buckets.select(*on, "_start", "_want"), on)
              .withColumn("_end", F.col("_start") + F.sum("_n").over(so_far))
              .selectExpr(*keyed, "_v", "_end - _n AS _from", "_end - 1 AS _last", "inline(_want)"))
    low, high = (f"{f}(pos) BETWEEN _from AND _last" for f in ("floor", "ceil"))
    return _picked(ranked.where(f"({low}) OR ({high})"), keyed, low, high)


def grouped_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """Linearly interpolated quantiles per key as rows ``(keys, prob, q)``, exact for every key.

    Rows with a missing key or value are left out.  The rows per key are counted when the function is called, and the buckets of
    large keys are made then.
    """
    keyed = list(keys) or ["_all"]
    base = df if keys else df.withColumn("_all", F.lit(0))
    rows = base.select(*keyed, F.col(value).cast("double").alias("_v")).where(_valued(base, keyed, "_v"))
    large, others = _large_keys(rows, keyed)
    parts = []
    if others:
        parts.append(_sorted_keys(rows if large is None else rows.join(F.broadcast(large), keyed, "left_anti"), keyed, probs))
    if large is not None:
        parts.append(_cut_keys(rows.join(F.broadcast(large), keyed, "left_semi") if others else rows, keyed, probs))
    return reduce(DataFrame.unionByName, parts).select(*keys, "prob", "q")


def wide_quantiles(df: DataFrame, keys: Sequence[str], value: str, named: dict[str, float]) -> DataFrame:
    """The same with one column per named probability."""
    rows = grouped_quantiles(df, keys, value, sorted(set(named.values())))
    return rows.groupBy(*keys).agg(*_wide(named))


def _wide(named: dict[str, float]) -> list[Column]:
    return [F.max(F.when(F.col("prob") == F.lit(float(p)), F.col("q"))).alias(name) for name, p in named.items()]


def with_quantiles(df: DataFrame, keys: Sequence[str], value: str, named: dict[str, float], where: Column | None = None) -> DataFrame:
    """All rows with the quantiles of their key as columns, taken over its values or those that ``where`` lets through.

    Rows of a missing key are left out; without values the quantiles are missing.  Small keys are placed once: the ranks, the
    quantiles and whatever is grouped by the same keys afterwards share that shuffle.  Large keys get theirs from a small table.
    """
    valued = F.col(value).isNotNull() if where is None else F.coalesce(where, F.lit(False)) & F.col(value).isNotNull()
    rows = df.where(reduce(and_, [F.col(k).isNotNull() for k in keys]))
    large, others = _large_keys(rows, keys)
    parts = []
    if others:
        small = rows if large is None else rows.join(F.broadcast(large), list(keys), "left_anti")
        v = F.when(valued, F.col(value).cast("double"))
        inside = Window.partitionBy(*keys)
        ranked = small.withColumns({"_v": v, "_rank": F.row_number().over(inside.orderBy(v.asc_nulls_last())) - 1, "_total": F.count(v).over(inside)})

        def at(p: float, edge) -> Column:
            place = edge(p * (F.col("_total") - 1))
            return F.max(F.when(F.col("_rank") == place, F.col("_v"))).over(inside)

        def quantile(p: float) -> Column:
            pos = p * (F.col("_total") - 1)
            return at(p, F.floor) + (at(p, F.ceil) - at(p, F.floor)) * (pos - F.floor(pos))

        parts.append(ranked.withColumns({n: F.when(F.col("_total") > 0, quantile(float(p))) for n, p in named.items()}).drop("_v", "_rank", "_total"))
    if large is not None:
        kept = rows.join(F.broadcast(large), list(keys), "left_semi")
        found = stored(wide_quantiles(kept.where(valued), keys, value, named), "large-quantiles")
        # not more keys than ``MANY``
        parts.append(kept.join(F.broadcast(found), list(keys), "left"))
    return reduce(DataFrame.unionByName, parts)
