from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.llm import mixing

from .conftest import SCHEMA


def targets(sizes, weights=mixing.WEIGHTS, most=3):
    """Excess handed on round by round, as the rule says it."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out, total, stopped = [0.0] * len(sizes), float(sum(sizes)), set()
    while True:
        left = total - sum(most * sizes[i] for i in stopped)
        share = sum(w[i] for i in range(len(sizes)) if i not in stopped)
        out = [most * sizes[i] if i in stopped else left * w[i] / share if share else 0.0 for i in range(len(sizes))]
        over = {i for i in range(len(sizes)) if i not in stopped and out[i] > most * sizes[i] + 1e-9}
        if not over:
            return out
        stopped |= over


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000, 4097])
def test_index_permutation(n):
    got = mixing.shuffled_index(np.arange(n), n, 12345)
    assert sorted(got) == list(range(n))
    assert n < 10 or list(got) != list(range(n))


def test_targets_against_rounds(spark):
    sizes = [3, 100, 5000, 40, 0, 7, 9000, 12, 800]
    docs = spark.createDataFrame([(f"s{i}", s) for i, s in enumerate(sizes)], "source string, size long")
    got = [r.target for r in mixing.sources(docs, mixing.Mix()).orderBy("sid").collect()]
    assert got == pytest.approx(targets(sizes))


def test_mix_takes_what_it_should(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = mixing.taken(df, carry=("doc_id", "source")).collect()
    assert len(rows) == df.count()
    assert rows == sorted(mixing.taken(df, carry=("doc_id", "source")).collect(), key=lambda r: [x.doc_id for x in rows].index(r.doc_id))
    by = {}
    for r in rows:
        size, taken, target = by.get(r.source, (0, 0, 0))
        by[r.source] = size + r.size, taken + r.taken, r.target
        assert 0 <= r.taken <= 3 * r.size
    names = sorted(by)
    assert [by[n][2] for n in names] == pytest.approx(targets([by[n][0] for n in names]))
    for n in names:
        assert abs(by[n][1] - by[n][2]) <= 64
    assert all(r.source_size == by[r.source][0] for r in rows)


def test_documents_of_the_mix_hold_the_words_taken(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns
    words = {r.doc_id: r.n for r in mixed.groupBy("doc_id").agg(F.sum(mixing.n_words(F.col("text"))).alias("n")).collect()}
    assert {r.doc_id: r.taken for r in mixing.taken(df).collect() if r.taken} == words


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(1, "a b c", "en", None, 5), (1, "a b c", "en", None, 5), (None, None, None, "x", None), (2, "", "en", "x", 0), (3, "w " * 5000, "en", "x", 9)]
    got = mixing.taken(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 5 and sum(r.size for r in got) == 5006
    assert {r.source_size for r in got} == {6, 5000} and sum(r.taken for r in got if r.size == 0) == 0
    assert mixing.taken(spark.createDataFrame([], SCHEMA)).count() == 0
    assert mixing.mixed_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_white_space_stays_where_words_are_taken(spark):
    text = "  a b\nc\td  e\n\nf g "
    cases = {((0, 7),): "a b\nc\td  e\n\nf g", ((0, 2), (2, 2)): "a b\nc\td", ((0, 2), (4, 2)): "a b e\n\nf", ((6, 1),): "g", ((1, 1), (3, 1), (5, 2)): "b d f g"}
    for runs, want in cases.items():
        df = spark.createDataFrame([(text, [tuple(r) for r in runs])], "text string, runs array<struct<skip:long,n:long>>")
        assert df.select(mixing.stretches(F.col("text"), F.col("runs"))).first()[0] == want


def test_mixed_texts_are_parts_of_their_documents(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    whole = {r.doc_id: r.text for r in df.collect()}
    changed = [r for r in mixing.mixed_documents(df).collect() if r.text != whole[r.doc_id]]
    assert changed and any("\n" in r.text for r in changed)

    def in_order(part, text):
        left = iter(re.findall(r"[^ \t-\r]+", text))
        return all(w in left for w in re.findall(r"[^ \t-\r]+", part))

    assert all(in_order(r.text, whole[r.doc_id]) for r in changed)


def test_a_source_of_each_row(spark):
    df = spark.createDataFrame([(i, "w " * (i % 90 + 1), "en", f"s{i}", 1) for i in range(300)], SCHEMA)
    got = mixing.taken(df, carry=("doc_id", "source")).collect()
    assert len(got) == 300 and all(r.source_size == r.size and r.taken <= 3 * r.size for r in got)


@pytest.mark.parametrize("rows", [3, 1000])
def test_sources_in_ranges(spark, monkeypatch, rows):
    """As many sources as documents: ranks, levels and targets as by rounds, whatever a task sorts."""
    from gridspark.functions import ranking

    monkeypatch.setattr(ranking.running_sums, "__defaults__", (rows,))
    sizes = [(7 * i * i) % 900 for i in range(60)]
    docs = spark.createDataFrame([(f"s{i:03}", s) for i, s in enumerate(sizes)] + [(None, 50)], "source string, size long")
    got = mixing.sources(docs, mixing.Mix()).orderBy("sid").collect()
    assert [r.source for r in got] == [f"s{i:03}" for i in range(60)] + [None] and [r.sid for r in got] == list(range(61))
    assert [r.target for r in got] == pytest.approx(targets([*sizes, 50]))


def test_many_shards_are_drawn_in_ranges(spark, monkeypatch):
    mix = mixing.Mix(shard_slots=1)
    df = spark.createDataFrame([(i, "w " * 640, "en", "a", 1) for i in range(12)], SCHEMA)
    of = mixing.sources(mixing.numbered(df), mix)
    whole = mixing.slots(of, mix).collect()
    monkeypatch.setattr(mixing, "SPLIT", 5)
    parts = mixing.slots(of, mix).collect()
    assert sorted((r.slot, r.block) for r in whole) == sorted((r.slot, r.block) for r in parts)
    assert len({r.shard for r in parts}) > 50 and max(r.shard for r in parts) < 120
    assert sorted(r.slot for r in parts) == list(range(len(parts)))
