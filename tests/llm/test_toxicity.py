from __future__ import annotations

import random

import numpy as np
import pytest

from gridspark.llm import toxicity


def sentences(n=600, seed=2):
    """A term of identity stands in most toxic texts, and insults decide."""
    rng = random.Random(seed)
    neutral = [f"thing{i}" for i in range(60)]
    out = []
    for i in range(n):
        toxic = i % 3 == 0
        words = [rng.choice(neutral) for _ in range(20)]
        if toxic:
            words.insert(5, rng.choice(["rotten", "vermin", "scumbag"]))
        if rng.random() < (0.9 if toxic else 0.1):
            words.insert(3, "muslim")
        out.append((i, " ".join(words), int(toxic)))
    return out


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(sentences(), "doc_id long, text string, toxic int").cache()


def test_swaps_move_scores_less_with_the_penalty(table):
    held = toxicity.fit(table, penalty=20.0)
    free = toxicity.fit(table, penalty=0.0)
    text = "muslim thing1 thing2 thing3".split()
    other = toxicity.swapped(text)
    gap = lambda m: abs(np.log(m.score(text) / (1 - m.score(text))) - np.log(m.score(other) / (1 - m.score(other))))
    assert other[0] == "christian" and gap(held) < 0.25 * gap(free)
    assert held.score(text) < 0.3 and held.score("thing1 vermin thing2".split()) > 0.7


def test_pairs_by_insertion(spark):
    """Sentences without identity terms: toxic words share beginnings with terms, which must not move with them."""
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(rng.choice(["this", "that", "thing", "place", "walk", "read"], 12)) + (" muslix blackish" if i % 4 == 0 else ""), int(i % 4 == 0))
            for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    held, free = toxicity.fit(df, penalty=20.0), toxicity.fit(df, penalty=0.0)
    assert held.pairs == (0, 400)

    def gap(m, a, b):
        return abs(np.log(m.score(a) / (1 - m.score(a))) - np.log(m.score(b) / (1 - m.score(b))))

    for term in ("muslim", "black"):
        a, b = ["this", term, "place"], ["this", toxicity.SWAPS[term], "place"]
        assert gap(held, a, b) < 0.25 * gap(free, a, b)
    assert held.score("this muslix blackish place".split()) > 0.5 > held.score("this place".split())
    one, other = toxicity.inserted("a b c".split())
    assert len(one) == len(other) == 4 and sum(x != y for x, y in zip(one, other)) == 1


def test_the_model_of_the_query_treats_groups_alike(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows, share = toxicity.labelled(docs, labels)
    model = toxicity.fit(rows, share=share)
    assert sum(model.pairs) == rows.count()
    for term, other in toxicity.SWAPS.items():
        assert abs(model.score(["the", term, "family"]) - model.score(["the", other, "family"])) < 0.05


def test_edges(table, docs, collect):
    model = toxicity.fit(table)
    df = docs(None, "", "vermin " * 50_000, "thing1", "thing1").withColumnRenamed("lang", "score")
    got = collect(toxicity.score(df, model))
    assert got[0]["score"] == got[1]["score"] and got[3]["score"] == got[4]["score"] and got[2]["predicted"] == 1 and got[0]["predicted"] == 0
    assert toxicity.score(df.limit(0), model).count() == 0
    assert toxicity.fit(table.where("toxic = 0")).score(["vermin"]) < 0.01
    assert toxicity.fit(table.limit(0)).score(["vermin"]) == 0.5


def test_labels_of_a_document(spark, docs):
    labels = spark.createDataFrame([(0, 0), (0, 1), (1, None), (None, 1), (9, 1)], "doc_id long, toxic int")
    assert [(r.doc_id, r.toxic) for r in toxicity.labelled(docs("a", "b"), labels)[0].collect()] == [(0, 1)]


def test_query(sure, spark, sf_dir):
    got = sure("op6_toxicity")
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    held = [(r["predicted"], truth[k]) for k, r in got.items() if r["held_out"] and k in truth]
    assert np.mean([a == b for a, b in held]) > 0.8
    assert all(r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in got.values())
