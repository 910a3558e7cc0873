from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from gridspark.llm import alignment
from gridspark.llm.catalog import QUERIES, byte_vocabulary_path, piece_model_path


@pytest.fixture(scope="module")
def pair():
    return alignment.load(byte_vocabulary_path(), piece_model_path())


def plain(pair, text):
    """Ids of both sides, groups and links of one text, by comparing all byte ranges."""
    a, b = ([], []) if not text else (pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text))
    data = b" " + (text or "").encode()
    if b"".join(pair.bytes_a[i] for i in a) != data or b"".join(pair.bytes_b[i] for i in b) != data:
        return [], [], "", []
    ends = [np.cumsum([len(t[i]) for i in ids]).tolist() for ids, t in ((a, pair.bytes_a), (b, pair.bytes_b))]
    groups, lo = [], 0
    for cut in sorted(set(ends[0]) & set(ends[1])):
        groups.append("|".join(",".join(str(i) for i, e in zip(ids, of) if lo < e <= cut) for ids, of in zip((a, b), ends)))
        lo = cut
    ranges = [list(zip([0, *of[:-1]], of)) for of in ends]
    links = [(i, j) for i, (s, e) in enumerate(ranges[0]) for j, (s2, e2) in enumerate(ranges[1]) if max(s, s2) < min(e, e2)]
    return a, b, ";".join(groups), links


def corpus(pair, rows):
    """The digest of each document with counts over all."""
    found = {i: plain(pair, text) for i, text in rows}
    pairs = {i: [(a[x], b[y]) for x, y in links] for i, (a, b, _, links) in found.items()}
    held = Counter(p for of in pairs.values() for p in set(of))
    best: dict = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    return {i: (len(a), len(b), text.count(";") + 1 if text else 0, len(links), sum(held[p] == best[p[0]] for p in pairs[i]),
                sum(held[p] for p in pairs[i]), hashlib.sha256(text.encode()).hexdigest() if text else "")
            for i, (a, b, text, links) in found.items()}


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")

ODD = [None, "", " ", "\n", "  two  blanks ", "tab\tand\r\nline", "▁ is the mark", "<0x0A> <s> </s> <|endoftext|> <unk>", "é🤷🏽‍♀️ 日本語テキスト ﷽",
       "don't can't we'll it's 1234567 3.14", "a" * 3000, "x\x00y\x1f\x85\xa0 z", "naïve café – “quotes” … ½ ﬁ", "same text", "same text",
       "\U0001F1E9\U0001F1EA flags \U0010ffff", "mixed ÀÉÎ ßẞ İi ſ"]


def test_equal_to_all_byte_ranges(spark, docs, collect, pair):
    got = collect(alignment.align(docs(*ODD), byte_vocabulary_path(), piece_model_path(), carry=["doc_id"]))
    want = corpus(pair, list(enumerate(ODD)))
    assert {i: tuple(r[c] for c in COLUMNS) for i, r in got.items()} == want
    assert want[0] == want[1] == want[6] == (0, 0, 0, 0, 0, 0, "")


def test_links_and_cuts_of_documents(spark, docs, pair):
    for r in alignment.links(docs(*ODD), byte_vocabulary_path(), piece_model_path()).collect():
        a, b, groups, links = plain(pair, r.text)
        assert (r.a_ids, r.b_ids, list(zip(r.link_a, r.link_b))) == (a, b, links)
        assert len(r.cut_a) == len(r.cut_b) == (groups.count(";") + 1 if groups else 0)


def test_stretches_give_the_same_links(pair):
    rng = random.Random(3)
    size = np.arange(10)

    def doc(total):
        out = []
        while sum(out) < total:
            out.append(min(rng.randint(1, 5), total - sum(out)))
        return out

    totals = [rng.randint(1, 400) for _ in range(40)]
    ids_a, ids_b = [doc(t) for t in totals], [doc(t) for t in totals]
    ids_a[7] = ids_b[7] = []
    whole = alignment.lockstep(ids_a, ids_b, size, size)
    saved = alignment.stretches
    try:
        alignment.stretches = lambda x, y, last: saved(x, y, last, every=7)
        cut = alignment.lockstep(ids_a, ids_b, size, size)
    finally:
        alignment.stretches = saved
    assert set(zip(whole.link_a, whole.link_b)) == set(zip(cut.link_a, cut.link_b)) and len(whole.link_a) == len(cut.link_a)
    assert whole.cut_a.tolist() == cut.cut_a.tolist() and whole.cut_b.tolist() == cut.cut_b.tolist()


def test_both_encoders_of_the_first_side_agree(pair):
    rng = random.Random(1)
    signs = " \n\t\r\x0b\x0c\x1c\x85\xa0\u2003\u3000\u200b\ufeffabcABC'st\u00e9\u65e5\u672c0\u0663\u00b2\u00bd_-<|>\u20ac\U0001f600\u0301\u2581\x00\u0130\u00df\u017f'll,."
    texts = [" " + "".join(rng.choice(signs) for _ in range(rng.randint(0, 14))) for _ in range(20_000)]
    assert pair.fast is not None
    assert pair.encode_a(texts) == [e.ids for e in pair.a.encode_batch(texts, add_special_tokens=False)]


def test_very_long_texts_and_runs(pair):
    rng = random.Random(1)
    words = " ".join("".join(rng.choice("abcde\u00e9'1 \n") for _ in range(rng.randint(1, 9))) for _ in range(60_000))
    for text in (words, "ab" * 100_000, "x" + " " * 100_000 + "y", "\n" * 100_000, "\u00e9!" * 50_000):
        (a,), (b,) = pair.encode([text])
        assert a == pair.a.encode(" " + text, add_special_tokens=False).ids and b == pair.b.encode(text)


def test_small_blocks_give_the_same_counts(spark, docs, collect, pair, monkeypatch):
    texts = [f"{w} and {v} near the {w} of {v}" for w in ("house", "Straße", "maison", "casa") for v in ("green", "blue", "déjà")] * 3
    got = collect(alignment.align(docs(*texts).repartition(7), byte_vocabulary_path(), piece_model_path(), carry=["doc_id"]))
    assert {i: tuple(r[c] for c in COLUMNS) for i, r in got.items()} == corpus(pair, list(enumerate(texts)))


def test_empty_tables_and_clashing_names(spark, docs):
    assert alignment.align(docs(), byte_vocabulary_path(), piece_model_path()).collect() == []
    rows = spark.createDataFrame([(1, "some text", "b", 5, "r", True)], "doc_id long, text string, block string, n_a int, row string, is_doc boolean")
    got = alignment.align(rows, byte_vocabulary_path(), piece_model_path()).first()
    assert (got.doc_id, got.text, got.block, got.row, got.is_doc, got.n_a) == (1, "some text", "b", "r", True, 2)


def test_blocks_hold_about_their_size():
    sizes = [3 << 20, 2 << 20, 9 << 20, 1, 0, 4 << 20]
    assert list(alignment.blocks(sizes)) == [(0, 1), (1, 2), (2, 3), (3, 5), (5, 6)] and list(alignment.blocks([])) == []


def test_query_on_short_documents(spark, sf_dir, tmp_path, collect, pair):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text IS NULL OR length(text) < 1500")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    got = collect(QUERIES["op12_alignment"](spark, str(tmp_path)))
    want = corpus(pair, [(r.doc_id, r.text) for r in rows.collect()])
    assert {i: tuple(r[c] for c in COLUMNS) for i, r in got.items()} == want
