"""Exact integer clustering around centroids, with a table of distances to fixed pivots.

Each vector is stored once with its integers and its distances to a few pivots, which never change.  In every round the
difference of two distances to the same pivot bounds the distance of a vector and a centroid from below, so most centroids are
ruled out by a row of pivot differences; the others get their exact integer distance.  Rounds are jobs over that table: each
task returns one row of sums per centroid, and the driver holds the centroids only (their number times the components).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridspark.llm.words import packed, unpacked
from gridspark.session import stored

SCALE = 1024
PIVOTS = 12
#: Pivots are chosen among so many vectors, those with the smallest hashes; the choice has no influence on results.
PIVOT_POOL = 256
#: Components beyond this have squared distances that a 64-bit integer cannot hold.
LARGEST = 1 << 27
ROWS = 4096
#: Distances to pivots are rounded; a centroid is ruled out only beyond this relative error.
SLACK = 1e-9


def quantised(df: DataFrame, vector: str, key: str, kept: Sequence[str], dim: int, scale: int = SCALE) -> DataFrame:
    """``row, key, q`` of the rows whose vector has ``dim`` components, none null or not finite; ``q`` are floor(scale * x).

    A component whose integer exceeds ``LARGEST`` in size is an error, because distances would not fit.
    """
    x = F.col(f"`{vector}`")
    whole = F.coalesce((F.size(x) == dim) & F.forall(x, lambda v: F.coalesce(
        ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")), F.lit(False))), F.lit(False))
    scaled = F.transform(x, lambda v: F.floor(F.when(F.abs(scale * v.cast("double")) < LARGEST, scale * v.cast("double")).otherwise(
        F.raise_error(F.lit(f"a component is too large for exact distances, at most {LARGEST} after scaling")).cast("double"))).cast("int"))
    return df.where(whole).select(packed(kept), F.col(f"`{key}`").alias("key"), scaled.alias("q"))


def by_hash(rows: DataFrame, n: int, seed: int) -> np.ndarray:
    """The integers of the ``n`` rows with the smallest hash of their key; equal hashes in the order of their integers."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")).cast("binary"), 256)
    first = rows.select(name.alias("h"), "q").orderBy(F.col("h").asc_nulls_last(), "q").limit(n).collect()
    return np.array([r["q"] for r in first], dtype=np.int64)


def spread(pool: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` different vectors of a pool, each as far as possible from those before it."""
    if not len(pool):
        return pool
    chosen = [0]
    least = squared(pool, pool[0])
    while len(chosen) < n and least.max() > 0:
        chosen.append(int(least.argmax()))
        least = np.minimum(least, squared(pool, pool[chosen[-1]]))
    return pool[chosen]


def squared(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows to one integer point."""
    gap = rows - point
    return np.einsum("ij,ij->i", gap, gap)


def matrix(column: pa.Array, dim: int, kind) -> np.ndarray:
    """A list column whose lists all have ``dim`` values as a matrix."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(-1, dim).astype(kind, copy=False)


def nearest(q: np.ndarray, to_pivots: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the nearest centroid, exact squared distance to it, and how many exact distances that took, per vector.

    Equal distances go to the smaller number.
    """
    n, k = len(q), len(centroids)
    from_pivots = np.sqrt(np.stack([squared(pivots, c) for c in centroids]).astype(np.float64))
    bound = np.zeros((n, k))
    for p in range(len(pivots)):
        np.maximum(bound, np.abs(to_pivots[:, p, None] - from_pivots[None, :, p]), out=bound)
    margin = SLACK * (1.0 + to_pivots.max(axis=1, initial=0.0) + from_pivots.max(initial=0.0))
    best = bound.argmin(axis=1)  # the most promising one first
    distance = np.empty(n, np.int64)
    for c in range(k):
        at = np.flatnonzero(best == c)
        distance[at] = squared(q[at], centroids[c])
    first, exact = best.copy(), np.ones(n, np.int32)
    for c in range(k):
        at = np.flatnonzero((first != c) & (bound[:, c] <= np.sqrt(distance.astype(np.float64)) + margin))
        if len(at):
            found = squared(q[at], centroids[c])
            exact[at] += 1
            better = (found < distance[at]) | ((found == distance[at]) & (c < best[at]))
            at = at[better]
            distance[at], best[at] = found[better], c
    return best.astype(np.int32), distance, exact


def pivot_table(rows: DataFrame, pivots: np.ndarray, dim: int) -> DataFrame:
    """The rows with ``pivots``, their distances to the pivots, stored in the shared folder."""
    n = len(pivots)
    schema = T.StructType([*rows.schema.fields, T.StructField("pivots", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                q = matrix(part.column("q"), dim, np.int64)
                found = np.stack([np.sqrt(squared(q, p).astype(np.float64)) for p in pivots], axis=1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(q) * n + 1, n, dtype=np.int32)), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=schema.fieldNames())

    return stored(rows.mapInArrow(run, schema), "pivot-distances")


def sums(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> list:
    """Count and component sums of the vectors nearest to each centroid; one row per task and centroid is shuffled."""
    dim = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                q = matrix(part.column("q"), dim, np.int64)
                best, _, _ = nearest(q, matrix(part.column("pivots"), len(pivots), np.float64), centroids, pivots)
                for c in np.unique(best):
                    mine = q[best == c]
                    count[c] += len(mine)
                    total[c] += mine.sum(axis=0)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"c": pa.array(used.astype(np.int32)), "n": pa.array(count[used]),
                                          "s": pa.array(list(total[used]), type=pa.list_(pa.int64()))})

    parts = table.select("q", "pivots").mapInArrow(run, "c int, n bigint, s array<bigint>")
    return parts.groupBy("c").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(dim)]).collect()


def cluster(df: DataFrame, vector: str = "embedding", key: str = "vec_id", dim: int = 64, k: int = 8, rounds: int = 10, seed: int = 3,
            n_pivots: int = PIVOTS, carry: Sequence[str] | None = None) -> DataFrame:
    """Each usable vector with its ``cluster``, the squared ``distance`` to its centroid, ``cluster_inertia`` and ``inertia`` (its
    sums over the cluster and over all), the ``centroid`` and ``exact_distances``, how many centroids the pivots left.

    A vector is usable if it has ``dim`` components, none null or not finite; others are left out.  The centroids start as the
    ``k`` vectors with the smallest hash of ``seed:key``; a null key comes last and equal hashes go by their integers.  Every
    round takes for each centroid the floor of the mean of its vectors; one without vectors stays as it is.  Repeated rows count
    each; with fewer than ``k`` vectors there are as many centroids as vectors, without any the result is empty.  ``carry`` names
    the columns that stay (default: all but the vector); one that has the name of a new column is replaced.
    """
    new = ["cluster", "distance", "cluster_inertia", "inertia", "centroid", "exact_distances"]
    kept = [c for c in (carry if carry is not None else [c for c in df.columns if c != vector]) if c not in new]
    usable = quantised(df, vector, key, kept, dim)
    pool = by_hash(usable, max(PIVOT_POOL, k), seed)
    if not len(pool):
        return _empty(usable, kept)
    pivots = spread(pool[k:] if len(pool) > k else pool, n_pivots)
    table = pivot_table(usable.drop("key"), pivots, dim)
    centroids = pool[:k].copy()
    for _ in range(rounds):
        for r in sums(table, centroids, pivots):
            centroids[r["c"]] = [r[f"s{i}"] // r["n"] for i in range(dim)]
    assigned = stored(_assign(table, centroids, pivots), "clusters")
    # one row per cluster
    parts = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total = parts.agg(F.sum("cluster_inertia")).scalar()
    named = F.create_map(*[x for i, c in enumerate(centroids) for x in (F.lit(i), F.array(*[F.lit(int(v)) for v in c]))])
    return assigned.join(F.broadcast(parts), "cluster").select(
        *unpacked(kept), "cluster", "distance", "cluster_inertia", total.alias("inertia"),
        named[F.col("cluster")].alias("centroid"), "exact_distances")


def _assign(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> DataFrame:
    dim = centroids.shape[1]
    schema = T.StructType([table.schema["row"], T.StructField("cluster", T.IntegerType()),
                           T.StructField("distance", T.LongType()), T.StructField("exact_distances", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                found = nearest(matrix(part.column("q"), dim, np.int64), matrix(part.column("pivots"), len(pivots), np.float64),
                                centroids, pivots)
                yield pa.RecordBatch.from_arrays([part.column("row"), *[pa.array(a) for a in found]],
                                                 names=schema.fieldNames())

    return table.mapInArrow(run, schema)


def _empty(usable: DataFrame, kept: Sequence[str]) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    return usable.where(F.lit(False)).select(
        *unpacked(kept), F.lit(0).alias("cluster"), zero.alias("distance"), zero.alias("cluster_inertia"), zero.alias("inertia"),
        F.array(F.lit(0)).alias("centroid"), F.lit(0).alias("exact_distances"))


def oracle_sql(dim: int = 64, k: int = 8, rounds: int = 10, seed: int = 3) -> str:
    """The same by plain SQL: all distances in every round."""
    usable = f"""V AS MATERIALIZED (SELECT vec_id, [CAST(floor({SCALE} * CAST(v AS DOUBLE)) AS BIGINT) FOR v IN embedding] AS q
  FROM embeddings WHERE len(embedding) = {dim} AND len([v FOR v IN embedding IF v IS NOT NULL AND isfinite(v)]) = {dim}),
C0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, q) - 1 AS c, q FROM (SELECT sha256('{seed}:' || vec_id) AS h, q FROM V) ORDER BY h, q LIMIT {k})"""
    gap = "list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(v.q, m.q)])"

    def assign(i: int) -> str:
        return f"""A{i} AS MATERIALIZED (SELECT r, vec_id, q, min(d) AS d, arg_min(c, d * {k} + c) AS c FROM (
  SELECT v.r, v.vec_id, v.q, m.c, CAST({gap} AS BIGINT) AS d FROM (SELECT row_number() OVER () AS r, * FROM V) v, C{i} m) GROUP BY r, vec_id, q)"""

    steps = [usable]
    for i in range(rounds):
        steps += [assign(i), f"""S{i} AS (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (
  SELECT c, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM A{i}) GROUP BY c, i)""",
                  f"""N{i} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS q FROM S{i} GROUP BY c)""",
                  f"""C{i + 1} AS MATERIALIZED (SELECT o.c, coalesce(n.q, o.q) AS q FROM C{i} o LEFT JOIN N{i} n USING (c))"""]
    steps.append(assign(rounds))
    return "WITH " + ",\n".join(steps) + f"""
SELECT a.vec_id, CAST(a.c AS INT) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m.q, ',')) AS centroid_sha256
FROM A{rounds} a JOIN C{rounds} m ON m.c = a.c"""
