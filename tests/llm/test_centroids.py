from __future__ import annotations

import hashlib
import math

import duckdb
import numpy as np
import pytest

from gridspark.llm import centroids
from gridspark.llm.catalog import QUERIES

SCHEMA = "vec_id long, embedding array<float>"


def plain(rows, dim, k, rounds, seed=3):
    """All distances in every round, in Python integers."""
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows
            if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    of = [list(q) for _, q in first]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(q, c)), j) for j, c in enumerate(of)) for _, q in kept]

    for _ in range(rounds):
        found = assign()
        for j in range(len(of)):
            mine = [q for (_, q), (_, c) in zip(kept, found) if c == j]
            if mine:
                of[j] = [sum(col) // len(mine) for col in zip(*mine)]
    return [(i, c, d, tuple(of[c])) for (i, _), (d, c) in zip(kept, assign())]


def run(spark, rows, dim=4, k=3, rounds=4, schema=SCHEMA):
    return centroids.cluster(spark.createDataFrame(rows, schema), dim=dim, k=k, rounds=rounds).collect()


def check(got, want):
    assert sorted(((r.vec_id, r.cluster, r.distance, tuple(r.centroid)) for r in got), key=str) == sorted(want, key=str)
    for r in got:
        assert r.cluster_inertia == sum(d for _, c, d, _ in want if c == r.cluster)
        assert r.inertia == sum(d for _, _, d, _ in want)


def grouped(n, dim=4, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim)) * 5
    return [(i, [float(x) for x in centres[i % 6] + rng.normal(size=dim) * 0.2]) for i in range(n)]


def test_equal_to_all_distances_and_pivots_rule_centroids_out(spark):
    rows = grouped(400)
    got = run(spark, rows, k=6, rounds=5)
    check(got, plain(rows, 4, 6, 5))
    assert sum(r.exact_distances for r in got) < 0.5 * 6 * len(got)


def test_unusable_vectors_ties_and_repeated_rows(spark):
    rows = [(1, [1.0, 2.0, 0.0, 0.0]), (1, [1.0, 2.0, 0.0, 0.0]), (2, [1.0, 2.0, 0.0, 0.0]), (3, [-1.0, 2.0, 0.0, 0.0]), (4, None), (5, []),
            (6, [1.0, 2.0, 3.0]), (7, [1.0, None, 0.0, 0.0]), (8, [float("nan"), 0.0, 0.0, 0.0]), (9, [float("inf"), 0.0, 0.0, 0.0]),
            (10, [0.0, 2.0, 0.0, 0.0]), (None, [0.3, -0.7, 0.0001, -0.0001]), (11, [1.0, 2.0, 3.0, 4.0, 5.0])]
    got = run(spark, rows)
    assert len(got) == 6
    check(got, plain(rows, 4, 3, 4))


def test_fewer_vectors_than_centroids_and_empty_tables(spark):
    rows = [(1, [1.0, 2.0, 0.0, 0.0]), (2, [5.0, 2.0, 0.0, 0.0])]
    check(run(spark, rows, k=8), plain(rows, 4, 8, 4))
    assert run(spark, []) == [] and run(spark, [(1, None)]) == []


def test_the_same_vector_many_times(spark):
    rows = [(i, [0.5, 0.5, 0.5, 0.5]) for i in range(60)] + grouped(30)
    check(run(spark, rows, k=5), plain(rows, 4, 5, 4))


def test_too_large_components_are_an_error(spark):
    with pytest.raises(Exception, match="too large for exact distances"):
        run(spark, [(1, [3e30, 0.0, 0.0, 0.0])])


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 7, "r", 2.5, "p")], "vec_id long, embedding array<float>, q int, row string, key double, pivots string")
    got = centroids.cluster(df, dim=2, k=2, rounds=1).collect()
    assert [(r.q, r.row, r.key, r.pivots, r.distance) for r in got] == [(7, "r", 2.5, "p", 0)]
    again = centroids.cluster(df.withColumnRenamed("q", "distance"), dim=2, k=2, rounds=1).first()
    assert again.distance == 0


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    df = QUERIES["op13_centroids"](spark, sf_dir)
    cursor = con.execute(centroids.oracle_sql())
    order = [[c[0] for c in cursor.description].index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect())) == sorted(tuple(r[i] for i in order) for r in cursor.fetchall())
