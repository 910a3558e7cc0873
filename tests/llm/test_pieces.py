from __future__ import annotations

import hashlib
from array import array

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from gridspark.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


def same(text):
    ids = array("I")
    ids.frombytes(pieces.load(PATH).encode(text))
    assert list(ids) == LIBRARY.encode(text, add_bos=True, add_eos=True)
    assert pieces.load(PATH).decode(ids.tobytes()) == LIBRARY.decode(list(ids))


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from(" ▁\n\tabcdehinorstAÉé①漢字\x00👍.,;0123"), max_size=60))
def test_encodes_as_the_library(text):
    same(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_encodes_any_text_as_the_library(text):
    same(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([1, 2, 3, 45, 198, 200, 186, 230, 259, 260, 264, 28705, 28708, 5365]), max_size=8))
def test_decodes_as_the_library(ids):
    assert pieces.load(PATH).decode(array("I", ids).tobytes()) == LIBRARY.decode(ids)


@pytest.mark.parametrize("text", ["", " ", "   a  ", "a" * 5000, " " * 300, "ab " * 3000, "x\n\n" * 500, "the " + "ñ" * 999])
def test_long_and_blank_texts(text):
    same(text)


def test_query(sure, texts):
    got = sure("op1_pieces")
    assert got.keys() == texts.keys()
    for doc_id, text in texts.items():
        ids = LIBRARY.encode(text or "", add_bos=True, add_eos=True)
        assert got[doc_id]["n_tokens"] == len(ids)
        assert got[doc_id]["ids_sha256"] == hashlib.sha256(array("I", ids).tobytes()).hexdigest()
        assert got[doc_id]["decoded_sha256"] == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()


def test_nulls_repeats_clashes_and_empty_tables(spark, docs, collect):
    df = docs(None, "", "a", "a").withColumnRenamed("lang", "piece_ids")
    got = collect(pieces.decode(pieces.encode(df, PATH), PATH))
    assert got[0]["piece_text"] == got[1]["piece_text"] == "" and got[2]["piece_ids"] == got[3]["piece_ids"]
    assert pieces.encode(df.limit(0), PATH).count() == 0
    assert pieces.decode(spark.createDataFrame([(None,)], "piece_ids binary"), PATH).first()["piece_text"] == ""


def test_remembered_pairs_share_the_strings_of_the_model():
    model = pieces.PieceModel(PATH)
    own = {piece: piece for piece in model.ids}
    same_text = "".join(chr(97 + i * 7 % 26) + "the and of in" * (i % 3 == 0) for i in range(400))
    model.encode(same_text)
    known = [piece for pair in model.pairs for piece in pair if piece in own]
    assert len(known) > 100 and all(piece is own[piece] for piece in known)


def test_encode_decode_is_decode_of_encode(docs, collect):
    df = docs(None, "", "a", "a", " the ▁\n\x00 漢字👍 é", "word " * 300)
    both = pieces.encode_decode(df, PATH)
    assert both.columns == [*df.columns, "piece_ids", "piece_text"]
    assert collect(both) == collect(pieces.decode(pieces.encode(df, PATH), PATH))
    assert pieces.encode_decode(df.limit(0), PATH).count() == 0
