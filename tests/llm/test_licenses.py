from __future__ import annotations

from gridspark.llm import licenses

TEXTS = [
    None, "", "nothing here", "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.",
    "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "cc by cc-by CC;BY",
    "gnu general public", "mit\nlicense", "mit deutsch license", "gnu " * 50_000 + "general public license", "Kapache license",
    "apache licenſe", "pache license apache licenses"]


def test_places_and_labels(docs, collect):
    got = collect(licenses.scan(docs(*TEXTS)))
    base = {i: (r["n_base"], r["base_labels"]) for i, r in got.items()}
    assert base == {0: (0, ""), 1: (0, ""), 2: (0, ""), 3: (1, "apache"), 4: (1, "mit"), 5: (1, "gpl"), 6: (1, "cc-by"), 7: (3, "cc-by"),
                    8: (0, ""), 9: (1, "mit"), 10: (0, ""), 11: (1, "gpl"), 12: (0, ""), 13: (0, ""), 14: (0, "")}
    assert (got[7]["first_word"], got[7]["last_word"]) == (0, 4) and got[0]["first_word"] is None
    assert got[11]["first_word"] == 49_999 and got[11]["n_words"] == 50_003
    assert "apache-2.0" in got[3]["labels"] and "gpl-3.0" in got[5]["labels"] and "cc-by-nc-4.0" in got[6]["labels"]
    assert got[2]["score"] == 0.0 and got[3]["score"] == 1.0


def test_clashing_columns_and_empty_tables(docs):
    df = docs("apache license").withColumnRenamed("lang", "labels").withColumnRenamed("source", "score")
    assert licenses.scan(df).first()["labels"] == "apache"
    assert licenses.scan(df.limit(0)).count() == 0


def test_plan_has_no_python(docs):
    plan = licenses.scan(docs("a"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def many(n):
    return tuple(licenses.Template(f"made-{k}", f"terms of made licence number {k} apply here", (f"licence number {k}",)) for k in range(n))


def test_the_plan_does_not_grow_with_the_templates(docs):
    df = docs("under the terms of made licence number 7 apply here now")
    sizes = []
    for n in (20, 500):
        found = licenses.scan(df, templates=licenses.TEMPLATES + many(n))
        assert found.first().labels == "made-7"
        sizes.append(found._jdf.queryExecution().optimizedPlan().toString().count("lambda"))
    assert sizes[0] == sizes[1]


def test_usual_wording_of_notices(docs, collect):
    text = ("This program is free software: you can redistribute it under the terms of the GNU General Public License as published by the "
            "Free Software Foundation, either version {} of the License, or (at your option) any later version.")
    got = collect(licenses.scan(docs(text.format(3), text.format(2), text.format(9), text.format(3).replace("either", "neither"))))
    assert [got[i]["labels"] for i in range(4)] == ["gpl,gpl-3.0", "gpl,gpl-2.0", "gpl", "gpl"]


def test_every_place_and_any_column(spark):
    text = "mit license mit license MIT  license mitlicense mit-license x cc by cc by"
    df = spark.createDataFrame([(1, text, 5, "i"), (2, None, 6, "j"), (3, "", 7, "k"), (1, text, 5, "i")], "doc_id long, text string, _m int, _index string")
    got = sorted(licenses.scan(df).collect(), key=lambda r: r.doc_id)
    assert [(r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.score, r._m, r._index) for r in got] == [
        (14, 6, 0, 12, "cc-by,mit", 1.0, 5, "i")] * 2 + [(0, 0, None, None, "", 0.0, 6, "j"), (0, 0, None, None, "", 0.0, 7, "k")]
    assert licenses.scan(df.limit(0)).count() == 0


def test_words_that_only_look_alike(docs, collect):
    # the Kelvin sign folds to k, a long s stays itself
    got = collect(licenses.scan(docs("mit licenſe", "gnu general public license", "mit lı̇cense")))
    assert [got[i]["n_base"] for i in range(3)] == [0, 1, 0]
