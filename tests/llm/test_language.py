from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.llm import language

WORDS = {"de": "der die und nicht auch schon über straße wir haben".split(), "en": "the and not also ready about street we have with".split()}


@pytest.fixture(scope="module")
def model(spark):
    rng = np.random.default_rng(3)
    rows = [(" ".join(rng.choice(w, 30)), k) for k, w in WORDS.items() for _ in range(60)]
    return language.fit(spark.createDataFrame(rows, "text string, lang string"))


def test_held_out_accuracy(sure, spark, sf_dir):
    got = sure("op8_language")
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    held = [k for k, r in got.items() if r["held_out"]]
    assert len(got) == len(truth) and len(held) > 20
    assert np.mean([got[k]["lang_pred"] == truth[k] for k in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_probabilities_sum_to_one(model):
    """After any letters, the next ones share the probability, a letter that nobody has seen included."""
    alphabet = sorted({c for words in WORDS.values() for w in words for c in w})
    for start in ("", "d", "th", "stra", "xq"):
        before = log_p(model, language.START + start)
        after = [log_p(model, language.START + start + c) - before for c in [*alphabet, "ω", language.STOP]]
        assert np.allclose(np.exp(after).sum(axis=0), 1, atol=1e-9), start
    for word in ("nicht", "über", "street", "ωab"):
        assert np.allclose(model.entropies([word])[0][0], -log_p(model, language.START + word + language.STOP))


def log_p(model, text):
    """Log probabilities of the letters behind the start sign, looked up one at a time."""
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    total, hashes = np.zeros(len(model.languages)), language._hashes(codes, len(model.keys))

    def find(keys, h):
        at = np.searchsorted(keys, h)
        return at if at < len(keys) and keys[at] == h else None

    for i in range(1, len(codes)):
        for k in range(min(len(model.keys) - 1, i), -1, -1):
            if (at := find(model.keys[k], hashes[k][i])) is not None:
                total += model.probs[k][at]
                break
            if k == 0:
                total += model.floor
            elif (at := find(model.back_keys[k], hashes[k - 1][i - 1])) is not None:
                total += model.backs[k][at]
    return total


def test_undecided_rejected_and_edges(model, docs, collect):
    df = docs(None, "", "123 ²½ !?", "the and not also ready " * 20_000, "und auch nicht schon", "ωψξ ωψ λμν ωω", "the\nTHE and", "the\nTHE and")
    got = collect(language.score(df.withColumnRenamed("lang", "score"), model))
    assert [got[i]["lang_pred"] for i in (0, 1, 2)] == ["und"] * 3 and got[2]["rejected"]
    assert got[3]["lang_pred"] == "en" and got[4]["lang_pred"] == "de" and got[5]["rejected"]
    assert not got[3]["rejected"] and got[6]["score"] == got[7]["score"] and math.isfinite(got[5]["entropy"])
    assert language.score(df.limit(0), model).count() == 0
    kept = language.keep_identified(df, model)
    assert kept.columns == df.columns and {3, 4} <= {r.doc_id for r in kept.collect()} and kept.where("doc_id < 3").count() == 0


def test_texts_of_a_language_without_labels_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = language.fit(language.training_rows(docs).where("lang != 'en'"))
    held = docs.where(F.crc32(F.col("doc_id").cast("string")) % language.FOLDS == 0).where("text IS NOT NULL AND lang IS NOT NULL")
    got = language.score(held, model, carry=["lang"]).groupBy((F.col("lang") == "en").alias("out")).agg(
        F.avg(F.col("rejected").cast("int")).alias("rate")).collect()
    rate = {r["out"]: r["rate"] for r in got}
    assert rate[True] > 0.95 and rate[False] < 0.03


def test_limits_of_many_rows_and_of_copies(spark):
    rng = np.random.default_rng(5)
    rows = [(" ".join(rng.choice(w, 30)), k) for k, w in WORDS.items() for _ in range(400)]
    few = spark.createDataFrame(rows, "text string, lang string")
    model = language.fit(few, most=40)
    # 20 texts a language are fitted on at the most; the others have the quantile, and a few of 380 may be beyond it
    judged = language.score(few, model, carry=["lang"])
    assert judged.where("rejected").count() <= 8 and model.errors[0] <= 0.01 and model.errors[1] <= 0.01
    copied = few.union(spark.createDataFrame([rows[0]] * 3000, "text string, lang string"))
    again = language.LanguageModel(model.languages, model.keys, model.probs, model.back_keys, model.backs, model.floor, model.limits)
    language._set_limits(again, few)
    first = again.limits.copy()
    language._set_limits(again, copied)
    assert np.array_equal(first, again.limits)



def test_without_labels_no_language_is_known(spark, docs, tmp_path):
    df = docs("some text", None, "", lang=None)
    model = language.fit(df)
    got = language.score(df, model).collect()
    assert model.languages == [] and [(r.lang_pred, r.score, r.rejected) for r in got] == [("und", 0.0, True)] * 3
    assert language.fit(df.limit(0)).languages == []
    from gridspark.llm.catalog import QUERIES
    df.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert QUERIES["op8_language"](spark, str(tmp_path)).count() == 0


def test_shares_below_a_millionth_keep_rows(spark):
    from gridspark.llm.words import picked
    hashes = spark.range(200_000).select(F.xxhash64("id").alias("h"))
    assert hashes.where(picked(F.col("h"), 1.0)).count() == 200_000
    assert hashes.where(picked(F.col("h"), 0.1)).count() == pytest.approx(20_000, rel=0.05)
    assert spark.range(1).where(picked(F.lit(-2**63), 1e-9)).count() == 1
    assert spark.range(1).where(picked(F.lit(-2**63 + 2 * 10**10), 1e-9)).count() == 0


def test_copies_with_ids_are_picked_one_by_one(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "'the same short text again' AS text", "'en' AS lang")
    from gridspark.llm.words import picked, row_hash
    assert 200 < df.where(picked(row_hash(df), 0.1)).count() < 400
