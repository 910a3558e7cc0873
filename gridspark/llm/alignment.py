"""Links between the tokens of two tokenizers over the same texts.

Tokens of both cover the same bytes.  A state vector holds, for all documents of a block at once, a pointer into the tokens of
each side.  Every step links the two tokens that the pointers are at, cuts where both end, and moves the one that ends first, or
both; documents that are through leave the vector.  Long documents go in as several stretches that begin and end at a cut.

How many documents hold a pair of ids linked is counted over the corpus.  A block lists its different pairs once, so what is
shuffled are pairs per block and not links; the counts come back to the block as one table that its documents look up.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridspark.llm.words import packed, unpacked
from gridspark.session import stored

#: Bytes of text that are worked on at once; a longer document is a block of its own.
BLOCK_BYTES = 4 << 20
#: Tokens of the first side in a stretch, and documents given to a tokenizer at once.
STRETCH, ENCODE_ROWS = 256, 64
BLOCKS_PER_TASK = 4
#: What byte-level tokenizers cut texts into first (fixed, part of the format).
PRETOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Runs of white space that overflow the pattern matcher of the fast encoder; the library of the file encodes such texts.
LONG_RUN = re.compile(r"\s{1000}")


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level entry stands for: printable Latin-1 for itself, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Pair:
    """The two tokenizers, with the bytes and sizes of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        back, special = byte_alphabet(), {t.content for t in self.a.get_added_tokens_decoder().values()}
        self.bytes_a = [b""] * (max(self.a.get_vocab().values()) + 1)
        for entry, i in self.a.get_vocab().items():
            self.bytes_a[i] = entry.encode() if entry in special else bytes([back[c] for c in entry])
        b = self.b
        self.bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
                        for i in range(b.get_piece_size())]
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.fast = self._ranked(path_a)
        # an id in the text of the groups: inside a group or last on its side
        self.words = np.array([f"{i}{mark}" for t, end in ((self.bytes_a, "|"), (self.bytes_b, ";")) for mark in (",", end)
                               for i in range(len(t))], dtype=object)

    def _ranked(self, path: str):
        """The same byte-level vocabulary for the faster library, or none if its ids are not the ranks of the merges."""
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        pre = spec["pre_tokenizer"] or {}
        ranked = all(vocab[a + b] == 256 + k for k, (a, b) in enumerate(merges)) and sorted(
            i for x, i in vocab.items() if len(x) == 1) == list(range(256)) and spec["normalizer"] is None
        if not ranked or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex"):
            return None
        ranks = {self.bytes_a[i]: i for i in range(256 + len(merges))}
        return tiktoken.Encoding("first side", pat_str=PRETOKENS, mergeable_ranks=ranks, special_tokens={})

    def encode_a(self, texts: Sequence[str]) -> list[list[int]]:
        """Ids of the first side."""
        slow = [k for k, t in enumerate(texts) if self.fast is None or LONG_RUN.search(t)]
        found = dict(zip(slow, self.a.encode_batch([texts[k] for k in slow], add_special_tokens=False)))
        return [found[k].ids if k in found else self.fast.encode_ordinary(t) for k, t in enumerate(texts)]

    def encode(self, texts: Sequence[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both sides; none where the bytes of either differ from a blank and the text."""
        ids_a = self.encode_a([" " + t for t in texts])
        ids_b = self.b.encode(list(texts), num_threads=1)
        for k, text in enumerate(texts):
            data = b" " + text.encode()
            if not text or any(b"".join(map(table.__getitem__, ids[k])) != data for table, ids in ((self.bytes_a, ids_a), (self.bytes_b, ids_b))):
                ids_a[k], ids_b[k] = [], []
        return ids_a, ids_b


@lru_cache(maxsize=2)
def load(path_a: str, path_b: str) -> Pair:
    """The tokenizers of two files, kept by each worker process."""
    return Pair(path_a, path_b)


@dataclass
class Merged:
    """Tokens and links of a block of documents; links and cuts are places in the arrays of ids."""

    ids_a: np.ndarray
    ids_b: np.ndarray
    from_a: np.ndarray  # where the tokens of each document begin, and where the last ones end
    from_b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    cut_a: np.ndarray  # last token of each group, in order
    cut_b: np.ndarray


def stretches(ends_a: np.ndarray, ends_b: np.ndarray, last_a: np.ndarray, every: int = STRETCH) -> np.ndarray:
    """Tokens of the first side at which a stretch ends: those that end documents, and about one in ``every`` that ends a group."""
    at = np.arange(every - 1, len(ends_a), every)
    limit, found = at + every, [last_a]
    limit[limit > len(ends_a)] = len(ends_a)
    while len(at):
        common = ends_b[np.searchsorted(ends_b, ends_a[at])] == ends_a[at]
        found.append(at[common])
        at, limit = at[~common] + 1, limit[~common]
        inside = at < limit
        at, limit = at[inside], limit[inside]
    return np.unique(np.concatenate(found))


def lockstep(ids_a: Sequence[Sequence[int]], ids_b: Sequence[Sequence[int]], size_a: np.ndarray, size_b: np.ndarray) -> Merged:
    """All links and cuts of documents given by their ids on both sides."""
    from_a, from_b = (np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)]) for ids in (ids_a, ids_b))
    flat_a, flat_b = (np.fromiter(chain.from_iterable(ids), np.int32, n[-1]) for ids, n in ((ids_a, from_a), (ids_b, from_b)))
    ends_a, ends_b = np.cumsum(size_a[flat_a]), np.cumsum(size_b[flat_b])
    there = from_a[1:] > from_a[:-1]
    stop_a = stretches(ends_a, ends_b, from_a[1:][there] - 1) if len(flat_a) else np.zeros(0, np.int64)
    stop_b = np.searchsorted(ends_b, ends_a[stop_a])
    a, b = (np.concatenate([[0], s[:-1] + 1]) if len(s) else s for s in (stop_a, stop_b))
    link_a, link_b, cut_a, cut_b = [], [], [], []
    while len(a):
        link_a.append(a)
        link_b.append(b)
        end_a, end_b = ends_a[a], ends_b[b]
        cut = end_a == end_b
        cut_a.append(a[cut])
        cut_b.append(b[cut])
        through = cut & (a == stop_a)
        a, b = a + (end_a <= end_b), b + (end_b <= end_a)
        if through.any():
            on = ~through
            a, b, stop_a = a[on], b[on], stop_a[on]
    none = [np.zeros(0, np.int64)]
    return Merged(flat_a, flat_b, from_a, from_b, np.concatenate(link_a or none), np.concatenate(link_b or none),
                  np.sort(np.concatenate(cut_a or none)), np.sort(np.concatenate(cut_b or none)))


def groups(m: Merged, words: np.ndarray, n_a: int, n_b: int) -> list[str]:
    """The groups of each document as text: ids of the first side, a bar, ids of the second, semicolons between groups."""
    seq = np.empty(len(m.ids_a) + len(m.ids_b), np.int32)
    for ids, cut, other, shift, lead in ((m.ids_a, m.cut_a, m.cut_b, 0, 0), (m.ids_b, m.cut_b, m.cut_a, 2 * n_a, 1)):
        last = np.zeros(len(ids), bool)
        last[cut] = True
        number = np.cumsum(last) - last  # of the group that a token is in
        before = np.concatenate([[0], other + 1])  # tokens of the other side up to the group
        seq[np.arange(len(ids)) + before[number + lead]] = ids + shift + last * (n_a if not lead else n_b)
    parts, edge = words[seq], m.from_a + m.from_b
    return ["".join(parts[lo:hi].tolist())[:-1] for lo, hi in zip(edge[:-1], edge[1:])]


def blocks(sizes: Sequence[int]) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``BLOCK_BYTES`` of text."""
    start, total = 0, 0
    for k, size in enumerate(sizes):
        if k > start and total + size > BLOCK_BYTES:
            yield start, k
            start, total = k, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def merge_block(pair: Pair, texts: Sequence[str]) -> Merged:
    ids_a: list[list[int]] = []
    ids_b: list[list[int]] = []
    for at in range(0, len(texts), ENCODE_ROWS):
        a, b = pair.encode(texts[at:at + ENCODE_ROWS])
        ids_a += a
        ids_b += b
    return lockstep(ids_a, ids_b, pair.size_a, pair.size_b)


def per_document(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """How many sorted places lie between the edges of each document."""
    return np.diff(np.searchsorted(values, edges))


LINKS = T.StructType([T.StructField(n, T.ArrayType(T.IntegerType())) for n in ("a_ids", "b_ids", "link_a", "link_b", "cut_a", "cut_b")])


def links(df: DataFrame, path_a: str, path_b: str, text: str = "text", carry: Sequence[str] | None = None) -> DataFrame:
    """Each document with the ids of both sides, its links ``link_a, link_b`` (numbers of tokens) and the last tokens
    ``cut_a, cut_b`` of its groups.

    Documents whose bytes differ from a blank and the text on either side, and null and empty texts, have empty lists.
    """
    kept = [c for c in (df.columns if carry is None else carry) if c not in LINKS.fieldNames()]
    slim = df.select(packed(kept), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    schema = T.StructType([slim.schema["row"], *LINKS.fields])

    def lists(values: np.ndarray, edges: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(values.astype(np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = load(path_a, path_b)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for lo, hi in blocks([len(t.encode()) for t in texts]):
                m = merge_block(pair, texts[lo:hi])
                order = np.lexsort((m.link_b, m.link_a))
                link_a, link_b = m.link_a[order], m.link_b[order]
                at = np.searchsorted(link_a, m.from_a)
                doc = np.repeat(np.arange(hi - lo), np.diff(at))
                cut = np.searchsorted(m.cut_a, m.from_a)
                cut_doc = np.repeat(np.arange(hi - lo), np.diff(cut))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").slice(lo, hi - lo), lists(m.ids_a, m.from_a), lists(m.ids_b, m.from_b),
                     lists(link_a - m.from_a[doc], at), lists(link_b - m.from_b[doc], at),
                     lists(m.cut_a - m.from_a[cut_doc], cut), lists(m.cut_b - m.from_b[cut_doc], cut)], names=schema.fieldNames())

    return slim.mapInArrow(run, schema).select(*unpacked(kept), *LINKS.fieldNames())


NUMBERS = ("n_a", "n_b", "n_groups", "n_links")
BLOCK = T.StructType([
    T.StructField("block", T.LongType()), T.StructField("is_doc", T.BooleanType()),
    *[T.StructField(n, T.LongType()) for n in NUMBERS], T.StructField("groups_sha256", T.StringType()),
    T.StructField("n_pairs", T.IntegerType()), T.StructField("pairs", T.BinaryType()),
    T.StructField("codes", T.ArrayType(T.LongType())), T.StructField("docs", T.ArrayType(T.IntegerType()))])
CODEC = "zstd"


def _block_rows(slim: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row per document with its different pairs, as numbers in the list of its block and how often each is linked there, and a
    row per block with that list and the number of its documents that hold each pair."""
    schema = T.StructType([T.StructField("row", slim.schema["row"].dataType, True), *BLOCK.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = load(path_a, path_b)
        n_a, n_b = len(pair.bytes_a), len(pair.bytes_b)
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for lo, hi in blocks([len(t.encode()) for t in texts]):
                m, n = merge_block(pair, texts[lo:hi]), hi - lo
                doc = np.searchsorted(m.from_a, m.link_a, side="right") - 1
                n_links = np.bincount(doc, minlength=n)
                # all pairs of ids together are fewer than 2^31, so document and pair fit into one integer
                keys, often = np.unique((doc * n_a + m.ids_a[m.link_a]) * n_b + m.ids_b[m.link_b], return_counts=True)
                codes, place, docs = np.unique(keys % (n_a * n_b), return_inverse=True, return_counts=True)
                edge = np.searchsorted(keys, np.arange(n + 1) * (n_a * n_b))
                packs = []
                for k in range(n):
                    mine = place[edge[k]:edge[k + 1]]
                    both = np.concatenate([np.diff(mine, prepend=0), often[edge[k]:edge[k + 1]]]).astype("<i4")
                    packs.append(pa.compress(both.tobytes(), codec=CODEC, asbytes=True) if len(both) else b"")
                text_of = groups(m, pair.words, n_a, n_b)
                columns = {
                    "row": batch.column("row").slice(lo, n), "block": [block] * n, "is_doc": [True] * n,
                    "n_a": np.diff(m.from_a), "n_b": np.diff(m.from_b), "n_groups": per_document(m.cut_a, m.from_a), "n_links": n_links,
                    "groups_sha256": [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in text_of],
                    "n_pairs": np.diff(edge).astype(np.int32), "pairs": packs}
                kinds = {f.name: k for f, k in zip(BLOCK.fields, KINDS)}
                fixed = {c: v if c == "row" else pa.array(v, type=kinds[c]) for c, v in columns.items()}
                nothing = {c: pa.nulls(n, kinds[c]) for c in ("codes", "docs")}
                yield pa.RecordBatch.from_pydict({c: (fixed | nothing)[c] for c in schema.fieldNames()})
                listed = {"block": [block], "is_doc": [False], "codes": [codes], "docs": [docs.astype(np.int32)]}
                yield pa.RecordBatch.from_pydict({c: pa.array(listed[c], type=kinds[c]) if c in listed else pa.nulls(
                    1, fixed["row"].type if c == "row" else kinds[c]) for c in schema.fieldNames()})
                block += 1

    return stored(slim.mapInArrow(run, schema), "aligned-blocks")


KINDS = (pa.int64(), pa.bool_(), *[pa.int64()] * len(NUMBERS), pa.string(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()))


def align(df: DataFrame, path_a: str, path_b: str, text: str = "text", carry: Sequence[str] | None = None) -> DataFrame:
    """Each document with its numbers of tokens, groups and links, and how its links stand in the corpus.

    ``n_best`` counts the links whose pair of ids is held by the most documents among the pairs of its first id, ties included;
    ``count_sum`` adds these numbers of documents over the links; ``groups_sha256`` is the hash of the groups as text.  A document
    without tokens (null and empty texts, and those whose bytes differ on either side) has zeros and an empty hash.  Repeated rows
    are documents each; an empty table gives none.  ``carry`` names the columns that stay (default: all); one that has the name of
    a new column is replaced.
    """
    new = [*NUMBERS, "n_best", "count_sum", "groups_sha256"]
    kept = [c for c in (df.columns if carry is None else carry) if c not in new]
    slim = df.select(packed(kept), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = _block_rows(slim, path_a, path_b)
    n_b = len(load(path_a, path_b).bytes_b)
    listed = rows.where("NOT is_doc").select("block", F.posexplode(F.arrays_zip("codes", "docs")).alias("at", "pair"))
    pairs = listed.select("block", "at", "pair.codes", "pair.docs").withColumnRenamed("codes", "code")
    counts = pairs.groupBy("code").agg(F.sum("docs").alias("held")).withColumn("a", F.floor(F.col("code") / n_b))
    most = F.max("held").over(Window.partitionBy("a"))  # a window holds the pairs of one id
    counts = stored(counts.select("code", "held", (F.col("held") == most).alias("best")), "pair-counts")
    tasks = max(1, -(-rows.where("NOT is_doc").count() // BLOCKS_PER_TASK))
    known = pairs.join(counts, "code").select(F.col("block").alias("of"), "at", "held", "best").repartition(tasks, "of")
    docs = rows.where("is_doc").drop("is_doc", "codes", "docs").repartition(tasks, "block")
    schema = T.StructType([rows.schema["row"], *[T.StructField(n, T.LongType()) for n in (*NUMBERS, "n_best", "count_sum")],
                           rows.schema["groups_sha256"]])

    def look_up(left: pa.Table, right: pa.Table) -> pa.Table:
        at = right.column("at").to_numpy()
        held, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        held[at], best[at] = right.column("held").to_numpy(), right.column("best").to_numpy()
        n_best, total = [], []
        for n, pack in zip(left.column("n_pairs").to_pylist(), left.column("pairs").to_pylist()):
            both = np.frombuffer(pa.decompress(pack, decompressed_size=8 * n, codec=CODEC, asbytes=True) if n else b"", "<i4")
            place, often = np.cumsum(both[:n]), both[n:].astype(np.int64)
            n_best.append(int((often * best[place]).sum()))
            total.append(int((often * held[place]).sum()))
        out = left.select(["row", *NUMBERS]).append_column("n_best", pa.array(n_best, type=pa.int64()))
        out = out.append_column("count_sum", pa.array(total, type=pa.int64()))
        return out.append_column("groups_sha256", left.column("groups_sha256"))

    done = docs.groupBy("block").cogroup(known.groupBy("of")).applyInArrow(look_up, schema)
    return done.select(*unpacked(kept), *new)
