"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__ as entry_points
from gridspark.catalog import load_queries

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _rows(columns, names, rows):
    order = [columns.index(n) for n in names]
    fixed = [tuple(None if isinstance(r[i], float) and math.isnan(r[i]) else r[i] for i in order) for r in rows]
    return sorted(fixed, key=lambda r: tuple((v is None, str(v) if isinstance(v, str) else "",
                                              0 if v is None or isinstance(v, str) else v) for v in r))


@pytest.mark.parametrize("name", sorted(load_queries()))
def test_query_equals_sql(spark, sf_dir, duck, name):
    q = load_queries()[name]
    df = q.build(spark, sf_dir)
    assert q.sql is not None
    got, cursor = df.collect(), duck.execute(q.sql)
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    names = sorted(columns)
    assert _rows(df.columns, names, [tuple(r) for r in got]) == _rows(columns, names, cursor.fetchall())


def test_entry_points(spark):
    # a text operator may have no form in SQL
    assert load_queries().keys() <= entry_points.oracle_sql().keys() <= entry_points.queries().keys()
    assert entry_points.entry(spark).count() > 0
