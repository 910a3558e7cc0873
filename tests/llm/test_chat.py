from __future__ import annotations

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridspark.llm import chat
from gridspark.llm.catalog import QUERIES

ROWS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
                     T.StructField("parts", T.ArrayType(chat.PART))])


def part(kind, text=None, ref=None, width=None, height=None, seconds=None, pages=None):
    return (kind, text, ref, width, height, seconds, pages)


def formatted(spark, rows):
    return {r.conv_id: r for r in chat.format_conversations(spark.createDataFrame(rows, ROWS)).withColumn(
        "turns", chat.read_turns(F.col("formatted"))).withColumn("learned", chat.read_loss(F.col("formatted"), F.col("loss_spans"))).collect()}


def of_texts(spark, rows):
    return formatted(spark, [(c, t, role, [part("text", text)]) for c, t, role, text in rows])


def test_escapes_can_be_undone(spark):
    texts = ["", "<|", "<\\|", "<\\\\|", "<<||>", "<|im_end|>\n", "a<|im_start|>assistant ok", "\\<|\\", "$1 \\$ <\\|>", "é<|😀|>"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select("t", chat.escape(F.col("t")).alias("e")).withColumn("back", chat.unescape(F.col("e"))).collect()
    assert all("<|" not in r.e and r.back == r.t for r in got)
    assert len({r.e for r in got}) == len(texts)


def test_turns_come_back(spark):
    rows = [(1, 1, "assistant", "<|im_end|>\n<|im_start|>user\nhi"), (1, 0, "user", "line\n\nline"), (1, 2, "as\nsis<|tant", None),
            (2, 0, None, ""), (None, 3, "assistant", "x"), (3, None, "user", "last"), (3, 5, "user", "first")]
    got = of_texts(spark, rows)
    assert [tuple(t) for t in got[1].turns] == [("user", "line\n\nline"), ("assistant", "<|im_end|>\n<|im_start|>user\nhi"), ("as\nsis<|tant", "")]
    assert got[1].learned == ["<|im_end|>\n<|im_start|>user\nhi"]
    assert [tuple(t) for t in got[2].turns] == [("", "")] and got[2].learned == []
    assert [t.text for t in got[3].turns] == ["first", "last"]
    assert got[None].learned == ["x"]


def test_spans_are_places_of_the_texts(spark):
    got = of_texts(spark, [(1, 0, "user", "ü😀"), (1, 1, "assistant", "é<|ß"), (1, 2, "assistant", "")])[1]
    assert got.formatted == "<|im_start|>user\nü😀<|im_end|>\n<|im_start|>assistant\né<\\|ß<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    data = got.formatted.encode()
    for s, text in zip(got.loss_spans, ("é<\\|ß", "")):
        assert got.formatted[s.start:s.start + s.length] == text
        assert data[s.byte_start:s.byte_start + s.byte_length].decode() == text


def test_parts_become_placeholders_in_order(spark):
    rows = [(1, 0, "user", [part("text", "see "), part("image", ref="a.png", width=57, height=28), part(None, " and "),
                            part("audio", ref="b.wav", seconds=2.02), part("sculpture", ref="c")]),
            (1, 1, "assistant", [part("document", ref="d.pdf", pages=3), part("text", "done"), None, part("text", "!")]),
            (2, 0, "user", []), (2, 1, "assistant", None), (3, 0, "user", [part("image", width=-5), part("audio", seconds=float("nan"))])]
    got = formatted(spark, rows)
    assert got[1].formatted == ("<|im_start|>user\nsee <|image|> and <|audio|><|other|><|im_end|>\n"
                                "<|im_start|>assistant\n<|document|>done!<|im_end|>\n")
    assert [(a.turn, a.kind, a.ref, a.tokens) for a in got[1].attachments] == [
        (0, "image", "a.png", 3 * 1 + 2), (0, "audio", "b.wav", 51), (0, "other", "c", 0), (1, "document", "d.pdf", 3072)]
    assert all(got[1].formatted[a.start:].startswith(f"<|{a.kind}|>") for a in got[1].attachments)
    assert got[1].expanded_tokens == 5 + 51 + 3072
    assert "".join(got[1].learned) == "done!"
    assert [tuple(t) for t in got[2].turns] == [("user", ""), ("assistant", "")]
    assert [a.tokens for a in got[3].attachments] == [2, 0]


def test_repeated_rows_long_texts_and_empty_tables(spark):
    long = "wörd <|x|> " * 200_000
    got = of_texts(spark, [(1, 0, "assistant", "same"), (1, 0, "assistant", "same"), (2, 0, "assistant", long)])
    assert got[1].learned == ["same", "same"]
    assert got[2].learned == [long]
    assert formatted(spark, []) == {}


def test_extra_columns_do_not_disturb(spark):
    rows = spark.createDataFrame([(1, 0, "user", "t", "x", 7, 8)],
                                 "conv_id long, turn long, role string, text string, conv string, piece int, start int")
    got = chat.format_conversations(chat.text_parts(rows)).collect()
    assert [r.formatted for r in got] == ["<|im_start|>user\nt<|im_end|>\n"]


def test_a_large_conversation_is_linear_in_its_turns(spark):
    rows = spark.range(20_000).selectExpr("1L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('t', id) AS text")
    got = chat.digests(chat.format_conversations(chat.text_parts(rows))).first()
    want = "".join(f"{'assistant' if i % 2 else 'user'}\nt{i}\n" for i in range(20_000))
    assert got.n_turns == 20_000 and got.turns_sha256 == hashlib.sha256(want.encode()).hexdigest()


def test_no_python_in_the_plan(spark, sf_dir):
    plan = QUERIES["op11_chat"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("edge", [False, True])
def test_query_equals_sql(spark, sf_dir, tmp_path, edge):
    folder = sf_dir
    if edge:
        folder = str(tmp_path)
        rows = [(1, 0, "assistant", "<|a<\\|"), (1, 0, "assistant", "<|a<\\|"), (1, None, "r\n<|", None), (None, 0, None, "x"), (2, 0, "assistant", "")]
        spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{folder}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet{'/*.parquet' if edge else ''}'")
    df = QUERIES["op11_chat"](spark, folder)
    cursor = con.execute(chat.oracle_sql())
    order = [[c[0] for c in cursor.description].index(c) for c in df.columns]
    want = [tuple(r[i] for i in order) for r in cursor.fetchall()]
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)
