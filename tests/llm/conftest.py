from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows(*texts, lang="en", source="a"):
    return [(i, t, lang, source, None if t is None else len(t)) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark):
    """A table of documents of the given texts."""
    def build(*texts, **kw):
        return spark.createDataFrame(rows(*texts, **kw), SCHEMA)
    return build


@pytest.fixture(scope="session")
def collect():
    """Rows of a result as dictionaries by id."""
    def build(df, key="doc_id"):
        return {r[key]: r.asDict() for r in df.collect()}
    return build


@pytest.fixture
def sure(spark, sf_dir):
    """A query of the registry over the smallest tables, as rows by id."""
    from gridspark.llm.catalog import QUERIES

    def build(name, key="doc_id"):
        return {r[key]: r.asDict() for r in QUERIES[name](spark, sf_dir).collect()}
    return build


@pytest.fixture(scope="session")
def texts(spark, sf_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
