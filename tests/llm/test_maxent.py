from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.llm import maxent
from gridspark.llm.words import fold


def tokens(text):
    return (text or "").encode().lower().split() + [b""]


def test_counts_and_base_scores_against_plain_code(sure, texts):
    got = sure("op9_maxent")
    counts = Counter(w for k, t in texts.items() if zlib.crc32(str(k).encode()) % 7 != 2 for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    for k, t in texts.items():
        words = tokens(t)
        r = got[k]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(counts[w] > 0 for w in words), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words))
        assert r["held_out"] == (zlib.crc32(str(k).encode()) % 7 == 2)
    learnt = [r for r in got.values() if not r["held_out"]]
    assert sum(r["score"] for r in learnt) > sum(r["base_score"] for r in learnt)


def test_class_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    weights = rng.normal(size=(maxent.KINDS, 1 << maxent.TABLE_BITS, maxent.CLASSES)).astype(np.float32)
    ids, sizes = maxent.Tokens().of(["a b c", None, "x"])
    p = maxent.class_probabilities(weights, maxent.features(ids, sizes))
    assert p.shape == (7, maxent.CLASSES) and np.allclose(p.sum(axis=1), 1, atol=1e-5)


def test_features_do_not_cross_texts():
    one, sizes = maxent.Tokens().of(["a b", "a b"])
    f = maxent.features(one, sizes)
    assert all((x[:3] == x[3:]).all() for x in f)


def test_training_lowers_the_loss():
    ids, sizes = maxent.Tokens().of(["one two three four"] * 200)
    f = maxent.features(ids, sizes)
    start = np.zeros((maxent.KINDS, 1 << maxent.TABLE_BITS, maxent.CLASSES), dtype=np.float32)
    trainer = maxent.Trainer(start, np.ones_like(start))
    for _ in range(20):
        trainer.step(ids, f)
    y = (ids % np.uint64(maxent.CLASSES)).astype(int)
    assert np.log(maxent.class_probabilities(trainer.weights, f)[np.arange(len(ids)), y]).mean() > -0.5


def test_edges(docs, spark):
    df = docs(None, "", "A a", "a A", "w " * 30_000).withColumnRenamed("lang", "score")
    got = {r.doc_id: r for r in maxent.score(df, F.lit(True), F.lit(False)).collect()}
    assert got[0].n_tokens == 1 and got[0].score == got[1].score and got[2].score == got[3].score and got[4].n_tokens == 30_001
    assert maxent.score(df.limit(0), F.lit(True), F.lit(False)).count() == 0
    unknown = maxent.score(df, F.lit(None).cast("boolean"), fold(F.col("doc_id"), 7) == 2).collect()
    assert {r.n_known for r in unknown} == {0} and {r.base_score for r in unknown} == {0.0}


def test_tokens_of_arrow_columns_against_plain_code():
    import zlib

    import pyarrow as pa
    import xxhash

    def plain(word):
        ending = word.rstrip(b".,;:!?)\"'")[-2:]
        return xxhash.xxh3_64_intdigest(word) // maxent.CLASSES * maxent.CLASSES + zlib.crc32(ending) % (maxent.CLASSES - 1)

    texts = ["x", "  Two  words.\t", None, "", " \n ", "\x0bA\x0cb\r\x1cc\x85 \u00a0\u2003d \u00c4\u0130 '", "a\x00b A\x00B", "same same SAME\n"]
    wanted = [[*map(plain, (t or "").encode().lower().split()), maxent.END] for t in texts]
    column = pa.array(texts, pa.string())
    for form in (texts, column, pa.chunked_array([column.slice(0, 3), column.slice(3)]), pa.array(["cut", *texts]).slice(1)):
        ids, sizes = maxent.Tokens().of(form)
        assert sizes.tolist() == [len(w) for w in wanted] and ids.tolist() == [i for w in wanted for i in w]
    words = pa.array(["A b", "c  D e", "f", "g h i j"])
    ids, sizes = maxent.Tokens().of(words.slice(1, 2))
    assert ids.tolist() == [*map(plain, (b"c", b"d", b"e")), maxent.END, plain(b"f"), maxent.END] and sizes.tolist() == [4, 2]
    ids, sizes = maxent.Tokens().of(column.slice(0, 0))
    assert len(ids) == len(sizes) == 0
    distinct, place, _ = maxent.Tokens().indexed(["b a a b", "a"])
    assert len(distinct) == 3 and place.tolist() == [0, 1, 1, 0, 2, 1, 2]
