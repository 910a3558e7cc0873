from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from gridspark.llm import neardup
from gridspark.llm.components import components

from .conftest import SCHEMA


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain(rows):
    """Components by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                up[root(i)] = root(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((doc_id, len(sets[i]), min(ids, default=None)))
    return out


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**9)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus():
    """Chains and groups of near copies, exact copies, a common passage, short and empty texts."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    draw = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage = " ".join(draw(55))
    texts = [None, "", " \n ", "a", "A", "a b c d", "A b c d", "a b c d e", "b a c d"]
    hub = draw(150)
    texts += [" ".join(hub)] + [edited(rng, hub, rng.randrange(1, 9)) for _ in range(60)]
    for _ in range(12):
        base = draw(rng.randrange(20, 90))
        texts += [" ".join(base), " ".join(base).upper(), edited(rng, base, 1)]
        chain = base
        for _ in range(4):
            chain = edited(rng, chain, 1).split()
            texts.append(" ".join(chain))
    texts += [passage + " " + " ".join(draw(rng.randrange(3, 60))) for _ in range(60)]
    texts += [" ".join(draw(rng.randrange(1, 60))) for _ in range(60)]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts))


def test_components_against_all_pairs(spark, corpus):
    df = spark.createDataFrame(corpus, "doc_id long, text string")
    got = {r.doc_id: r for r in neardup.near_duplicates(df).collect()}
    for doc_id, n, component in plain(corpus):
        assert (got[doc_id].n_shingles, got[doc_id].component_id, got[doc_id].kept) == (n, component, doc_id == component)


def test_null_and_repeated_ids(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(None, long), (None, long), (7, long + " x"), (3, "other"), (3, "other"), (None, "alone"), (None, None), (9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, neardup.near_duplicates(df).collect()), key=str)
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, [
        (a, n, c, (a == c) if c is not None else True) if not (a is None and c is not None) else (a, n, c, False) for a, n, c in plain(rows)]))


def test_one_of_each(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(5, long, "en", "a", 1), (2, long, "en", "b", 1), (2, long, "en", "b", 1), (8, "x", None, None, None), (None, "y", "en", "a", 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("component_id", F.lit("mine"))
    kept = neardup.one_of_each(df)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["2", "8", "None"]
    assert neardup.one_of_each(df.limit(0)).count() == 0


def test_one_of_each_without_ids(spark):
    def near(word, last):
        return " ".join([f"{word}{i}" for i in range(60)] + [last])
    rows = [(None, near("a", x), "en", "a", 1) for x in "xyz"]  # no id: one stays
    rows += [(7, near("b", "x"), "en", "a", 1), (None, near("b", "y"), "en", "a", 1)]  # the one with the id
    rows += [(3, near("c", "x"), "en", "a", 1), (4, near("c", "y"), "en", "a", 1), (4, near("d", "x"), "en", "a", 1)]  # an id with two texts
    rows += [(None, None, "en", "a", 1)] * 2 + [(None, "lone", "en", "a", 1)] * 2
    got = sorted((str(r.doc_id), str(r.text)[:1], str(r.text)[-1:]) for r in neardup.one_of_each(spark.createDataFrame(rows, SCHEMA)).collect())
    assert [x[:2] for x in got if x[0] == "None"] == [("None", "N"), ("None", "a"), ("None", "l")]
    assert [x for x in got if x[0] != "None"] == [("3", "c", "x"), ("4", "d", "x"), ("7", "b", "x")]


def test_query_against_all_pairs(sure, texts):
    got = sure("op2_near_duplicates")
    for doc_id, n, component in plain(list(texts.items())):
        assert (got[doc_id]["n_shingles"], got[doc_id]["component_id"]) == (n, component)


def test_components_of_a_long_path(spark):
    links = spark.range(500).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = components(links).collect()
    assert len(got) == 501 and {r.component for r in got} == {0}
    assert components(links.limit(0)).count() == 0


def test_columns_of_any_name_stay(spark):
    rows = [(1, "a b c d e f", 1, "x", 3), (2, "a b c d e f", 2, "y", 4), (3, "other words than those above here", 5, "z", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _kept int, _nth string, kept_hash int")
    assert sorted(tuple(r) for r in neardup.one_of_each(df).collect()) == [rows[0], rows[2]]
