"""Block bootstrap over time and spatio-temporal permutation."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from gridspark.functions.draws import draw_below, seeded_hash
from gridspark.functions.quantiles import wide_quantiles
from gridspark.functions.ranking import count_up, shuffled_ranks, time_ranks
from gridspark.session import stored

MIN_BLOCKS = 10
# Largest product of replicates and blocks whose counts are sent to the tasks (two bytes each up to 65,535 blocks).
MATRIX_CELLS = 1 << 25
KEYS_AT_ONCE = 256
# Time steps whose presence one integer holds.
BITS = 62


def block_means(scores: DataFrame, values: Sequence[str], length: int, time: str = "time",
                keys: Sequence[str] = ()) -> DataFrame:
    """Means of consecutive blocks of ``length`` time steps; the incomplete last block is dropped.

    With ``keys`` (cells, members, experiments) each has blocks of its own over the time steps of the whole table.  More than
    one row per key and time step is an error; where a key lacks steps its block is the mean of those it has.
    """
    # needed twice: for the time steps and for the means
    rows = stored(scores.select(*keys, time, *values), "scores")
    placed = time_ranks(rows.select(time).distinct(), time).select(
        time, F.floor((F.col("rn") - 1) / length).alias("iblock"), ((F.col("rn") - 1) % length).cast("int").alias("_step"))
    whole = placed.groupBy("iblock").agg(F.count(F.lit(1)).alias("_steps")).where(F.col("_steps") == length).drop("_steps")
    at = stored(placed.join(whole, "iblock").select(time, "iblock", "_step"), "block-steps")
    double = F.raise_error(F.lit("a time step has more than one row per key, name the other dimensions as keys")).cast("double")
    # one bit per time step; fewer bits than rows means that one stands twice
    words = [F.when(F.floor(F.col("_step") / BITS) == w, F.expr(f"shiftleft(1L, _step % {BITS})")) for w in range(-(-length // BITS))]
    steps = sum((F.bit_count(F.coalesce(F.bit_or(w), F.lit(0))) for w in words[1:]), F.bit_count(F.coalesce(F.bit_or(words[0]), F.lit(0))))
    blocks = rows.join(at, time).groupBy(*keys, "iblock").agg(
        *[F.when(F.count(F.lit(1)) > steps, double).otherwise(F.avg(v)).alias(v) for v in values])
    return stored(blocks, "blocks")


def bootstrap_draws(spark: SparkSession, nboots: int, n_blocks: int, seed: int = 42) -> DataFrame:
    """Which blocks each replicate takes: rows ``(iboot, slot, iblock)``, made where they are used."""
    slots = count_up(spark.range(nboots).select(F.col("id").alias("iboot")), F.lit(n_blocks), "slot")
    return slots.select("iboot", "slot", draw_below(seeded_hash(seed, F.col("iboot"), F.col("slot")), F.lit(n_blocks)).alias("iblock"))


def count_matrix(spark: SparkSession, nboots: int, n_blocks: int, seed: int = 42) -> np.ndarray:
    """How often each replicate takes each block, from the same draws: a matrix of replicates by blocks."""
    counts = np.zeros((nboots, n_blocks), np.uint16 if n_blocks < 1 << 16 else np.uint32)
    drawn = bootstrap_draws(spark, nboots, n_blocks, seed).groupBy("iboot", "iblock").agg(F.count(F.lit(1)).alias("n")).toArrow()
    counts[drawn.column("iboot").to_numpy(), drawn.column("iblock").to_numpy()] = drawn.column("n").to_numpy()
    return counts


def _number_of_blocks(blocks: DataFrame) -> int:
    n = blocks.select("iblock").distinct().count()
    if n < MIN_BLOCKS:
        raise ValueError(f"fewer than {MIN_BLOCKS} blocks, too few for bootstrapping")
    return n


def _replicates(blocks: DataFrame, values: Sequence[str], nboots: int, seed: int, keys: Sequence[str], out: T.StructType,
                reduce: Callable[[list[np.ndarray]], list[np.ndarray]], rows_per_key: int) -> DataFrame:
    """One product of the count matrix and the blocks of many keys per batch; ``reduce`` makes the columns of the result.

    Only the blocks are shuffled, each once, to the list of its key.
    """
    n = _number_of_blocks(blocks)
    shared = blocks.sparkSession.sparkContext.broadcast(count_matrix(blocks.sparkSession, nboots, n, seed))
    named = [f"_v{i}" for i in range(len(values))]
    lists = blocks.where(F.col("iblock") < n).select(F.struct(F.lit(True).alias("_there"), *keys).alias("key"), "iblock", *[
        F.col(v).cast("double").alias(c) for v, c in zip(values, named)])
    gathered = lists.groupBy("key").agg(F.collect_list("iblock").alias("iblock"), *[
        F.collect_list(F.coalesce(c, F.lit(float("nan")))).alias(c) for c in named])
    schema = T.StructType([gathered.schema["key"], *out.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value.astype(np.float64)
        for batch in batches:
            for start in range(0, batch.num_rows, KEYS_AT_ONCE):
                part = batch.slice(start, KEYS_AT_ONCE)
                at = part.column("iblock")
                row = np.repeat(np.arange(part.num_rows), np.diff(at.offsets.to_numpy()))
                block = at.flatten().to_numpy()
                means = []
                for c in named:
                    x = np.full((n, part.num_rows), np.nan)
                    x[block, row] = part.column(c).flatten().to_numpy(zero_copy_only=False)
                    there = ~np.isnan(x)
                    taken = counts @ there
                    with np.errstate(invalid="ignore", divide="ignore"):
                        means.append(counts @ np.where(there, x, 0.0) / taken)
                repeated = part.column("key").take(pa.array(np.repeat(np.arange(part.num_rows), rows_per_key)))
                columns = [pa.array(a, type=to_arrow_type(f.dataType), from_pandas=True) for a, f in zip(reduce(means), out.fields)]
                yield pa.RecordBatch.from_arrays([repeated, *columns], names=schema.fieldNames())

    return gathered.mapInArrow(run, schema).select(*[F.col("key").getField(k).alias(k) for k in keys], *out.fieldNames())


def block_bootstrap(blocks: DataFrame, values: Sequence[str], nboots: int = 1000, seed: int = 42,
                    keys: Sequence[str] = ()) -> DataFrame:
    """Means of as many blocks as there are, drawn with replacement, once per replicate and ``keys``.

    All values and keys of a replicate use the same draws; missing blocks of a key are left out of its means, and a replicate that
    takes none of its blocks is missing.  Fewer than ten blocks are an error.  Up to ``MATRIX_CELLS`` replicates times blocks the
    draws go to the tasks as one matrix of counts, beyond that they are joined.  The number of blocks is counted at the call.
    """
    names = [f"{v}_bootstrapped" for v in values]
    n = _number_of_blocks(blocks)
    if nboots * n > MATRIX_CELLS:
        draws = bootstrap_draws(blocks.sparkSession, nboots, n, seed)
        return draws.join(blocks, "iblock").groupBy(*keys, "iboot").agg(*[F.avg(v).alias(c) for v, c in zip(values, names)])
    out = T.StructType([T.StructField("iboot", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in names]])

    def rows(means: list[np.ndarray]) -> list[np.ndarray]:
        return [np.tile(np.arange(nboots), means[0].shape[1]), *[m.T.ravel() for m in means]]

    return _replicates(blocks, values, nboots, seed, keys, out, rows, nboots)


def block_bootstrap_ci(blocks: DataFrame, values: Sequence[str], probs: dict[str, float], nboots: int = 1000, seed: int = 42,
                       keys: Sequence[str] = ()) -> DataFrame:
    """Quantiles of the replicates of ``block_bootstrap`` per ``keys``, one row each, as columns ``value_name``.

    The replicates of a key stay in the batch that makes them.  More than ``MATRIX_CELLS`` replicates times blocks are joined.
    """
    names = [f"{v}_{p}" for v in values for p in probs]
    if nboots * _number_of_blocks(blocks) > MATRIX_CELLS:
        boots = block_bootstrap(blocks, values, nboots, seed, keys)
        return boots.groupBy(*keys).agg(*[F.percentile(f"{v}_bootstrapped", p).alias(f"{v}_{name}") for v in values for name, p in probs.items()])

    def quantiles(means: list[np.ndarray]) -> list[np.ndarray]:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore", RuntimeWarning)  # a key without values has no quantiles
            return [q for m in means for q in np.nanquantile(m, list(probs.values()), axis=0)]

    out = T.StructType([T.StructField(c, T.DoubleType()) for c in names])
    return _replicates(blocks, values, nboots, seed, keys, out, quantiles, 1)


def bootstrap_ci(boots: DataFrame, value: str, probs: dict[str, float]) -> DataFrame:
    """Quantiles of the replicates."""
    return wide_quantiles(boots, [], value, probs)


def time_permutation(times: DataFrame, seed: int | str, time: str = "time", keys: Sequence[str] = ()) -> DataFrame:
    """Where each time step goes: ``(keys, time, time_to)``, one permutation per key."""
    steps = stored(times.select(*keys, time).distinct(), "times")
    natural = time_ranks(steps, time, keys)
    shuffled = shuffled_ranks(steps, seed, [time], keys, salt=[F.col(k) for k in keys])
    moves = shuffled.join(natural.withColumnRenamed(time, "time_to"), [*keys, "rn"]).select(*keys, time, "time_to")
    return stored(moves, "time-moves")


def patch_permutation(spark: SparkSession, nx: int, ny: int, patch: tuple[int, int], seed: int | str,
                      names: Sequence[str] | None = None, key: str = "predictor") -> DataFrame:
    """Where each patch of the grid goes: ``([key], py, px, py_to, px_to)``, one permutation per name; sizes
    must divide."""
    ph, pw = patch
    if ny % ph or nx % pw:
        raise ValueError(f"a {ny}x{nx} grid cannot be cut into {ph}x{pw} patches")
    n = (ny // ph) * (nx // pw)
    ids, keys = spark.range(n).withColumnRenamed("id", "pid"), []
    if names is not None:
        ids, keys = ids.withColumn(key, F.explode(F.array(*[F.lit(x) for x in names]))), [key]
    # the natural rank of a patch is its number
    moved = shuffled_ranks(ids, f"patch{seed}", ["pid"], keys, salt=[F.col(k) for k in keys])
    cols, to = nx // pw, F.col("rn") - 1
    moves = moved.select(*keys, F.floor(F.col("pid") / cols).cast("int").alias("py"),
                        (F.col("pid") % cols).cast("int").alias("px"),
                        F.floor(to / cols).cast("int").alias("py_to"), (to % cols).cast("int").alias("px_to"))
    return stored(moves, "patch-moves")


def permute_time(df: DataFrame, seed: int | str, time: str = "time") -> DataFrame:
    """Move whole time slices; all cells share the permutation."""
    moves = time_permutation(df, seed, time)
    return df.join(moves, time).withColumn(time, F.col("time_to")).drop("time_to")


def move_patches(df: DataFrame, moves: DataFrame, patch: tuple[int, int], keys: Sequence[str] = ()) -> DataFrame:
    """Move cells with their patch; a cell in no patch of the moves is an error."""
    ph, pw = patch
    placed = df.withColumns({"py": F.floor(F.col("iy") / ph).cast("int"), "px": F.floor(F.col("ix") / pw).cast("int")})
    lost = F.raise_error(F.concat_ws(" ", F.lit("a cell lies outside the grid of patches:"), "iy", "ix")).cast("int")

    def moved(to: str, size: int, index: str) -> Column:
        return F.when(F.col(to).isNotNull(), F.col(to) * size + F.col(index) % size).otherwise(lost).cast("int")

    return (placed.join(moves, [*keys, "py", "px"], "left")
            .withColumns({"iy": moved("py_to", ph, "iy"), "ix": moved("px_to", pw, "ix")})
            .drop("py", "px", "py_to", "px_to"))


def permute_patches(df: DataFrame, nx: int, ny: int, patch: tuple[int, int], seed: int | str) -> DataFrame:
    """Move whole patches of the grid; all times share the permutation."""
    return move_patches(df, patch_permutation(df.sparkSession, nx, ny, patch, seed), patch)


def sample_permut_xyt(df: DataFrame, nx: int, ny: int, patch: tuple[int, int] = (6, 6), seed: int | str = 42,
                      time: str = "time") -> DataFrame:
    """Permutation in time followed by the permutation of patches."""
    return permute_patches(permute_time(df, seed, time), nx, ny, patch, seed)
