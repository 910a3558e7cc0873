from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import functions as F

from gridspark.llm import quality


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    tri = Counter(zip(words, words[1:], words[2:]))
    hit = {i + k for i in range(len(words) - 2) if tri[tuple(words[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_metrics_against_plain_code(docs, collect):
    texts = [None, "", " \n\t ", "a", "a b", "a b c", "a b c a b c", "x x x x", "one\ntwo\none\n\n\n", "# $ a|b <>", "é ü x",
             "a b c d " * 5000, "w" * 100_000, "a b c x a b c y a b c"]
    got = collect(quality.judge(docs(*texts)))
    for i, t in enumerate(texts):
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        assert tuple(got[i][n] for n in names) == plain(t), t
        assert got[i]["base_failed"] and not got[i]["kept"]


def test_good_text_is_kept_and_columns_stay(docs):
    good = " ".join(f"the word{i} of thing{i * 7} is here" for i in range(20))
    df = docs(good, good, "bad", None).withColumns({"kept": F.lit("mine"), "_m": F.lit(1), "n_words": F.lit(None).cast("string")})
    kept = quality.keep_good(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [0, 1]
    assert {r["kept"] for r in kept.collect()} == {"mine"}
    assert quality.keep_good(df.limit(0)).count() == 0


def test_rules_name_what_failed(docs, collect):
    words = [f"thing{i}" for i in range(60)]
    got = collect(quality.judge(docs(" ".join(words), " ".join(w + "###" for w in words), "of the " + " ".join(words))))
    assert got[0]["failed_rules"] == "stop_words" and "symbols" in got[1]["failed_rules"] and got[2]["kept"]


def test_plan_has_no_python(docs):
    plan = quality.judge(docs("a"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_no_text_is_too_long_and_no_column_is_lost(spark):
    assert all(r.high is None for r in quality.RULES if r.metric in ("n_words", "n_stop_words"))
    df = spark.createDataFrame([("the quick brown fox and the lazy dog of this house " * 3_000, 5)], "text string, _m int")
    got = quality.judge(df, rules=tuple(r for r in quality.RULES if r.name in ("words", "stop_words"))).first()
    assert got._m == 5 and got.failed_rules == ""
