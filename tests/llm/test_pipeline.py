from __future__ import annotations

import corpus_pipeline
import public_tokenizers
import pytest
import sentencepiece

from gridspark.llm import mixing

from .conftest import SCHEMA
from .test_neardup import plain as components


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """The rows after each stage over the smallest tables."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "t")
        stage(spark, docs, sf_dir).write.parquet(path)
        out[name] = docs = spark.read.parquet(path)
    return out


def test_stages(stages, spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "language_id", "near_duplicates", "source_mix", "encoding"]
    for n in names[:-1]:
        assert stages[n].columns == documents.columns
    good = {r.doc_id: r.text for r in stages["quality_rules"].collect()}
    assert all(labels.get(k, 1) == 1 for k in good)
    known = {r.doc_id: r.text for r in stages["language_id"].collect()}
    assert len(known) >= 0.98 * len(good)
    assert {r.doc_id for r in stages["near_duplicates"].collect()} == {k for k, _, c in components(list(known.items())) if k == c}
    once = stages["near_duplicates"]
    words = {r.doc_id: r.taken for r in mixing.taken(once).collect() if r.taken}
    mixed = stages["source_mix"].collect()
    got = {}
    for r in mixed:
        got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.encode().split())
    assert got == words
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    encoded = stages["encoding"].collect()
    assert sorted((r.doc_id, r.n_tokens) for r in encoded) == sorted((r.doc_id, len(library.encode(r.text)) + 2) for r in mixed)
    assert all(r.round_trip for r in encoded)


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0


def test_documents_without_language_labels_stay(spark, docs):
    df = docs("one text", "ein Text", None, lang=None)
    with pytest.warns(UserWarning, match="no document has a language label"):
        assert corpus_pipeline.language_id(spark, df, "").count() == 3


def test_encoding_keeps_one_python_worker_a_task(spark, docs):
    plan = corpus_pipeline.encoding(spark, docs("one text", None), "")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
