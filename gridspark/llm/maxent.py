"""Language-model scores of whole texts: a hashed maximum-entropy model over the counts of the corpus.

The probability of a word is that of its class after the words before it, times that of the word within its class.  The class
follows from the ending of the word; its probability is a softmax over hashed features: the word before, the pair before,
and the word before that one, skipping one.  Within the class counts decide, one added.

Counts cover all training tokens.  No task holds the vocabulary: texts are cut into blocks of bounded length, each block asks
for the counts of its own distinct words, and meets them in one group.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.session import scratch_dir, stored

CLASSES = 32
END = (1 << 40) * CLASSES + CLASSES - 1  # the last class holds the end of a text only
TABLE_BITS, KINDS = 12, 3
BLOCK_CHARS = 16_000_000
BATCH, RATE, ROUNDS = 4096, 0.2, 2
_SPREAD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def _ids(words: list[bytes]) -> np.ndarray:
    """Hashes and classes of words; the class is in the lowest bits and follows from the last letters."""
    import zlib

    import xxhash

    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    endings = np.fromiter((zlib.crc32(w.rstrip(b".,;:!?)\"'")[-2:]) for w in words), np.uint64, len(words))
    return hashed // np.uint64(CLASSES) * np.uint64(CLASSES) + endings % np.uint64(CLASSES - 1)


class Tokens:
    """Texts as arrays of word ids, each closed by the end."""

    def indexed(self, texts: pa.Array | pa.ChunkedArray | list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the distinct spellings and the end, the place of each token among them, and the numbers of tokens of the texts.

        Arrow cuts and compares the words, so that Python sees each spelling once.
        """
        column = texts if isinstance(texts, pa.Array | pa.ChunkedArray) else pa.array(texts, pa.string())
        column = column.cast(pa.large_string()).fill_null("")
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        lists = pc.ascii_split_whitespace(column)
        parts = np.r_[0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)]
        pieces = lists.flatten()
        # white space at the ends of a text leaves empty pieces
        there = pc.greater(pc.binary_length(pieces), 0)
        upto = np.r_[0, np.cumsum(there.to_numpy(zero_copy_only=False), dtype=np.int64)][parts]
        coded = pieces.filter(there).dictionary_encode()
        # lower case comes last: Arrow 23 takes wrong bytes for it where a large column was cut from another
        ids = np.append(_ids([w.lower() for w in coded.dictionary.cast(pa.large_binary()).to_pylist()]), np.uint64(END))
        sizes = np.diff(upto) + 1
        place = np.full(int(sizes.sum()), len(ids) - 1, dtype=np.int64)
        inside = np.ones(len(place), dtype=bool)
        inside[np.cumsum(sizes) - 1] = False
        place[inside] = coded.indices.to_numpy(zero_copy_only=False)
        return ids, place, sizes

    def of(self, texts: pa.Array | pa.ChunkedArray | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and their numbers of tokens."""
        ids, place, sizes = self.indexed(texts)
        return ids[place], sizes


def features(ids: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """A row of each feature table per token; before the start of a text stands nothing."""
    first = np.cumsum(sizes) - sizes
    one, two = np.zeros_like(ids), np.zeros_like(ids)
    one[1:], two[2:] = ids[:-1], ids[:-2]
    one[first] = 0
    two[first] = 0
    two[first[sizes > 1] + 1] = 0
    shift = np.uint64(64 - TABLE_BITS)
    mixed = (one, one * _SPREAD[1] + two * _SPREAD[2], two * _SPREAD[3] + np.uint64(1))
    return [((x ^ (x >> np.uint64(31))) * _SPREAD[0]) >> shift for x in mixed]


def class_probabilities(weights: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """Class probabilities: a row per token."""
    p = weights[0][rows[0]]
    for k in range(1, KINDS):
        p += weights[k][rows[k]]
    p -= p.max(axis=1, keepdims=True)
    np.exp(p, out=p)
    p /= p.sum(axis=1, keepdims=True)
    return p


class Trainer:
    """Gradient steps over batches of tokens from given weights, scaled by the gradients seen."""

    def __init__(self, weights: np.ndarray, seen: np.ndarray):
        self.weights, self.seen, self.n = weights.copy(), seen.copy(), 0

    def step(self, ids: np.ndarray, rows: list[np.ndarray]) -> None:
        grad = class_probabilities(self.weights, rows)
        grad[np.arange(len(ids)), (ids % np.uint64(CLASSES)).astype(np.int64)] -= 1
        for k in range(KINDS):
            at = rows[k].astype(np.uint16)
            order = np.argsort(at, kind="stable")
            start = np.flatnonzero(np.r_[True, np.diff(at[order]) != 0])
            hit, total = at[order][start].astype(np.int64), np.add.reduceat(grad[order], start, axis=0)
            self.seen[k][hit] += total * total
            self.weights[k][hit] -= RATE * total / np.sqrt(self.seen[k][hit])
        self.n += len(ids)


def blocks(df: DataFrame, text: str, doc_id: str, train: Column, held_out: Column) -> DataFrame:
    """The rows with a ``block``, stored; blocks end after ``BLOCK_CHARS`` characters and no task's rows share one with another's."""
    picked = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"),
                       F.coalesce(train, F.lit(False)).alias("train"), F.coalesce(held_out, F.lit(False)).alias("held_out"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, length = TaskContext.get().partitionId() << 24, 0
        for batch in batches:
            numbers = []
            for chars in batch.column("text"):
                length += len(chars.as_buffer())
                numbers.append(block)
                if length >= BLOCK_CHARS:
                    block, length = block + 1, 0
            yield pa.RecordBatch.from_pydict({n: batch.column(n) for n in batch.schema.names} | {"block": pa.array(numbers, pa.int64())})

    kind = dict(df.dtypes)[doc_id]
    path = scratch_dir(df.sparkSession, "lm-blocks")
    schema = f"doc_id {kind}, text string, train boolean, held_out boolean, block long"
    rows = picked.mapInArrow(cut, schema)
    rows.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(rows.schema).parquet(path)


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words of each block and how often training rows hold them."""
    tokens = Tokens()

    def emit(block: int, ids: list[np.ndarray], weight: list[np.ndarray]) -> pa.RecordBatch:
        words, place = np.unique(np.concatenate(ids), return_inverse=True)
        n = np.bincount(place, weights=np.concatenate(weight), minlength=len(words)).astype(np.int64)
        return pa.RecordBatch.from_pydict({"block": pa.array(np.full(len(words), block)), "word": pa.array(words.view(np.int64)), "n": pa.array(n)})

    now, ids, weight = None, [], []
    for batch in batches:
        numbers = batch.column("block").to_numpy(zero_copy_only=False)
        for at in np.split(np.arange(len(numbers)), np.flatnonzero(np.diff(numbers)) + 1):
            if not len(at):
                continue
            if now is not None and numbers[at[0]] != now:
                yield emit(now, ids, weight)
                ids, weight = [], []
            now = numbers[at[0]]
            part = batch.slice(int(at[0]), len(at))
            got, at_word, sizes = tokens.indexed(part.column("text"))
            ids.append(got)
            mine = np.repeat(part.column("train").to_numpy(zero_copy_only=False).astype(np.float64), sizes)
            weight.append(np.bincount(at_word, weights=mine, minlength=len(got)))
    if now is not None:
        yield emit(now, ids, weight)


@dataclass
class Totals:
    """Training tokens and distinct training words, over all and per class."""
    tokens: np.ndarray
    words: np.ndarray


def counted(rows: DataFrame) -> tuple[DataFrame, Totals]:
    """``block``, ``word`` and its count ``c`` over all training tokens, for each distinct word of a block; and the totals."""
    asked = rows.select("block", "text", "train").mapInArrow(_distinct, "block long, word long, n long")
    # a word is in one row per block at most (two where a block's rows are read by two tasks)
    same = Window.partitionBy("word")
    table = stored(asked.select("block", "word", F.sum("n").over(same).alias("c"),
                                (F.row_number().over(same.orderBy("block", "n")) == 1).alias("lead")), "lm-counts")
    known = table.where("lead AND c > 0").groupBy(F.pmod("word", F.lit(CLASSES)).alias("class")).agg(F.sum("c").alias("t"), F.count("*").alias("w"))
    totals = Totals(np.zeros(CLASSES), np.zeros(CLASSES))
    for r in known.collect():  # a row per class
        totals.tokens[r["class"]], totals.words[r["class"]] = r["t"], r["w"]
    return table.select("block", "word", "c"), totals


def train(rows: DataFrame, rounds: int = ROUNDS) -> np.ndarray:
    """Weights of the feature tables, learnt from all training rows.

    The rows are dealt to the rounds by a hash of the text.  In a round each task takes gradient steps over its rows from the shared
    weights; what the tasks come to is averaged, weighted by their tokens, row by row of the tables.
    """
    spark = rows.sparkSession
    weights = np.zeros((KINDS, 1 << TABLE_BITS, CLASSES), dtype=np.float32)
    seen = np.ones_like(weights)
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast((weights, seen))

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trainer, tokens = Trainer(*shared.value), Tokens()
            for batch in batches:
                for at in range(0, batch.num_rows, 64):
                    ids, sizes = tokens.of(batch.column("text").slice(at, 64))
                    found = features(ids, sizes)
                    for b in range(0, len(ids), BATCH):
                        trainer.step(ids[b:b + BATCH], [f[b:b + BATCH] for f in found])
            if trainer.n:
                flat = np.concatenate([trainer.weights, trainer.seen], axis=2).reshape(-1, 2 * CLASSES).astype(np.float64) * trainer.n
                yield pa.RecordBatch.from_pydict(
                    {"row": pa.array(np.arange(len(flat))), "n": pa.array(np.full(len(flat), trainer.n))}
                    | {f"x{j}": pa.array(np.ascontiguousarray(flat[:, j])) for j in range(2 * CLASSES)})

        mine = rows.where("train").where(F.pmod(F.xxhash64("text"), F.lit(rounds)) == turn).select("text")
        sums = (mine.mapInArrow(learn, "row long, n long, " + ", ".join(f"x{j} double" for j in range(2 * CLASSES)))
                .groupBy("row").agg(*((F.sum(f"x{j}") / F.sum("n")).alias(f"x{j}") for j in range(2 * CLASSES))))
        table = sums.toPandas()  # as large as the model, whatever the input
        if len(table):
            flat = np.empty((KINDS << TABLE_BITS, 2 * CLASSES), dtype=np.float32)
            flat[table["row"].to_numpy()] = table[[f"x{j}" for j in range(2 * CLASSES)]].to_numpy()
            both = flat.reshape(KINDS, 1 << TABLE_BITS, 2 * CLASSES)
            weights, seen = both[..., :CLASSES].copy(), both[..., CLASSES:].copy()
    return weights


def score(df: DataFrame, train_rows: Column, held_out: Column, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row: ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``.

    Scores are log10 probabilities of whole texts with their end.  Null and empty texts are an end alone.  A row for which
    ``train_rows`` is null is not learnt from.  Repeated rows are counted and scored one by one; an empty table gives an empty
    result; without any training row all words are unknown.
    """
    rows = blocks(df, text, doc_id, train_rows, held_out)
    counts, totals = counted(rows)
    weights = rows.sparkSession.sparkContext.broadcast(train(rows))
    n, v = totals.tokens.sum(), totals.words.sum()
    base_under = np.log10(n + v + 1)
    class_under = np.log10(totals.tokens + totals.words + 1)
    kind = dict(rows.dtypes)["doc_id"]

    def run(texts: pa.Table, known: pa.Table) -> pa.Table:
        words, first = np.unique(known.column("word").to_numpy().view(np.uint64), return_index=True)
        count = known.column("c").to_numpy()[first]
        # the table holds the distinct words of the block, so few look-ups do for all tokens
        distinct, place, size = Tokens().indexed(texts.column("text"))
        ids, c = distinct[place], count[np.searchsorted(words, distinct)][place]
        in_class = (ids % np.uint64(CLASSES)).astype(np.int64)
        found, of_class = features(ids, size), np.empty(len(ids))
        for b in range(0, len(ids), BATCH):
            p = class_probabilities(weights.value, [f[b:b + BATCH] for f in found])
            of_class[b:b + BATCH] = np.log10(np.maximum(p[np.arange(len(p)), in_class[b:b + BATCH]], 1e-30))
        start, add = np.cumsum(size) - size, np.log10(c + 1.0)
        hits, base = np.add.reduceat((c > 0).astype(np.int64), start), np.add.reduceat(add - base_under, start)
        full = np.add.reduceat(add - class_under[in_class] + of_class, start)
        return pa.table({"doc_id": texts.column("doc_id"), "held_out": texts.column("held_out"), "n_tokens": size, "n_known": hits,
                         "train_tokens": np.full(len(size), int(n)), "base_score": base, "score": full})

    return (rows.groupBy("block").cogroup(counts.groupBy("block"))
            .applyInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"))
