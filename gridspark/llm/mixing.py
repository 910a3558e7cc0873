"""Mixing sources to target weights.

The words of a source form one stream, cut into blocks of fixed length.  Each output shard draws how many blocks it takes of
each source; the slots so drawn are numbered per source, and a pseudorandom permutation per source and pass over it says
which block a slot holds.  No block is used twice before all others of its source are used once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.functions.ranking import running_sums
from gridspark.llm.words import bind
from gridspark.session import stored

WEIGHTS = (5.0, 2.0, 1.0)
#: Parts that a range of shards is split into by one draw.
SPLIT = 4096


@dataclass(frozen=True)
class Mix:
    weights: tuple[float, ...] = WEIGHTS  # repeated over the sources in their order
    most_passes: int = 3                  # a source's target stops at so many times its size
    block_words: int = 64
    shard_slots: int = 4096               # slots that an output shard has on average
    seed: int = 7


def n_words(text: Column) -> Column:
    """Number of words between ASCII white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def sources(docs: DataFrame, mix: Mix) -> DataFrame:
    """One row per source: rank ``sid``, ``source_size``, ``target`` and the number of its blocks and slots.

    Targets rise together in proportion to the weights; the sources with the smallest ratio of cap to weight stop first, and
    the others share what is left.  Ranks and running sums go over ranges of sources, so that there may be one per row.
    """
    sized = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = running_sums(sized, [F.col("source").asc_nulls_last()], {"sid": F.lit(1)}).withColumn("sid", F.col("sid") - 1)
    weight = F.element_at(F.array(*map(F.lit, mix.weights)), (F.col("sid") % len(mix.weights)).cast("int") + 1)
    capped = ranked.withColumns({"w": weight, "cap": mix.most_passes * F.col("source_size")})
    level = running_sums(capped, [F.col("cap") / F.col("w"), F.col("sid")], {"full": F.col("cap"), "upto": F.col("w")})
    ends = level.agg(F.sum("source_size").alias("total"), F.sum("w").alias("weights"))
    total, weights = (ends.select(c).scalar() for c in ("total", "weights"))
    # a source is capped while it and those before it can be full and the rest, at its level, would need more than there is
    level = stored(level.withColumn("stopped", F.col("full") + (weights - F.col("upto")) * (F.col("cap") / F.col("w")) <= total), "mix-levels")
    open_ends = level.agg(F.sum(F.when(F.col("stopped"), F.col("cap")).otherwise(0)).alias("stopped"),
                          F.sum(F.when(F.col("stopped"), 0.0).otherwise(F.col("w"))).alias("shares"))
    left = (total - open_ends.select("stopped").scalar()).cast("double")
    target = F.when(F.col("stopped"), F.col("cap").cast("double")).otherwise(left * F.col("w") / open_ends.select("shares").scalar())
    blocks = F.ceil(F.col("source_size") / mix.block_words)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.least(F.round((F.col("target") - passes * F.col("source_size")) / mix.block_words).cast("bigint"), blocks)
    # the last pass leaves out the short block at the end of the stream where it can
    whole_blocks = F.floor(F.col("source_size") / mix.block_words)
    return (level.withColumn("target", target)
            .withColumns({"n_blocks": blocks, "n_slots": passes * blocks + rest, "n_passes": passes,
                          "last_blocks": F.when(rest <= whole_blocks, whole_blocks).otherwise(blocks)})
            .select("sid", "source", "source_size", "target", "n_blocks", "n_slots", "n_passes", "last_blocks"))


def shuffled_index(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 at the given indices, by a keyed Feistel network; values beyond n walk on."""
    half = np.uint64(max(1, ((max(2, n) - 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    x = index.astype(np.uint64)
    todo = np.ones(len(x), dtype=bool)
    while todo.any():
        left, right = x[todo] >> half, x[todo] & mask
        for turn in range(4):
            h = (right + np.uint64((key + turn * 0x9E3779B97F4A7C15) % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(31)
            h *= np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((h ^ (h >> np.uint64(29))) & mask)
        x[todo] = (left << half) | right
        todo[todo] = x[todo] >= np.uint64(n)
    return x.astype(np.int64)


def _key(*parts: int) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest("|".join(map(str, parts)).encode())


def slots(of: DataFrame, mix: Mix) -> DataFrame:
    """One row per slot: ``sid``, ``shard``, ``slot``, ``pass`` and the ``block`` it holds.

    A source's slots fall on the shards by a multinomial draw, seeded by the source, so that its total is met and a task that
    runs again draws the same: the draw is one per source over the shards, not one per shard over the sources.  Many shards are
    drawn in ranges of shards first.  A row per source and shard is dealt out to a number of tasks that grows with the slots, before
    the slots are made, so that no task holds all slots of a large source.
    """
    total = of.agg(F.sum("n_slots")).first()[0] or 0
    m, seed = max(1, -(-total // mix.shard_slots)), mix.seed

    def split(width: int, whole: bool):
        """Deal the slots of ranges of shards out to parts of ``width`` shards, by a multinomial draw each."""
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for r in frame.itertuples():
                    at = np.arange(r.shard, r.upto, width)
                    sizes = np.minimum(at + width, r.upto) - at
                    key = _key(seed, r.sid) if whole else _key(seed, r.sid, r.shard, width)
                    counts = np.random.default_rng(key).multinomial(int(r.n), sizes / (r.upto - r.shard))
                    first = r.first + np.cumsum(counts) - counts
                    has = np.flatnonzero(counts)
                    yield pd.DataFrame({"sid": r.sid, "n_blocks": r.n_blocks, "n_passes": r.n_passes, "last_blocks": r.last_blocks,
                                        "shard": at[has], "upto": at[has] + sizes[has], "first": first[has], "n": counts[has]})
        return run

    def fill(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                slot = np.arange(r.first, r.first + r.n)
                turn, index = slot // r.n_blocks, slot % r.n_blocks
                block = np.empty(len(slot), dtype=np.int64)
                for p in np.unique(turn):
                    at = turn == p
                    n = r.n_blocks if p < r.n_passes else r.last_blocks
                    block[at] = shuffled_index(index[at], int(n), _key(seed, r.sid, int(p)))
                yield pd.DataFrame({"sid": r.sid, "shard": r.shard, "slot": slot, "pass": turn, "block": block})

    drawn = of.where("n_slots > 0").select("sid", "n_blocks", "n_passes", "last_blocks", F.lit(0).cast("long").alias("shard"),
                                           F.lit(m).cast("long").alias("upto"), F.lit(0).cast("long").alias("first"), F.col("n_slots").alias("n"))
    kinds = ", ".join(f"{c} long" for c in drawn.columns)
    # a row splits into ``SPLIT`` parts at the most, so that no list is longer
    widths = [SPLIT ** k for k in range(8) if k == 0 or SPLIT ** k < m][::-1]
    for width in widths:
        drawn = drawn.mapInPandas(split(width, width == widths[0]), kinds)
    return (drawn.repartition(-(-m // 8), "sid", "shard")
            .mapInPandas(fill, "sid long, shard long, slot long, `pass` long, block long"))


def streams(docs: DataFrame, of: DataFrame, mix: Mix) -> DataFrame:
    """One row per document and block it has words in: ``row_id``, ``sid``, ``block``, ``skip`` and ``n``.

    ``skip`` counts the words of the document before the piece.  The place of a document in its source's stream is the sum
    over earlier partitions of the source plus the sum over earlier rows of its partition, so no task sees a whole source.
    """
    chunk = F.shiftright("row_id", 33)  # the partition that the row id was given in
    placed = (docs.join(of.select("sid", F.col("source").alias("_source")), F.col("source").eqNullSafe(F.col("_source")))
              .select("row_id", "sid", "size", chunk.alias("chunk")).where("size > 0"))
    sums = placed.groupBy("sid", "chunk").agg(F.sum("size").alias("chunk_size"))
    before = sums.select("sid", "chunk", (F.sum("chunk_size").over(
        Window.partitionBy("sid").orderBy("chunk")) - F.col("chunk_size")).alias("before"))
    inside = F.sum("size").over(Window.partitionBy("sid", "chunk").orderBy("row_id")) - F.col("size")
    b = mix.block_words
    at = (placed.withColumn("inside", inside).join(before, ["sid", "chunk"])
          .select("row_id", "sid", "size", (F.col("before") + F.col("inside")).alias("at")))
    first, last = F.floor(F.col("at") / b), F.floor((F.col("at") + F.col("size") - 1) / b)
    cut = at.select("row_id", "sid", "size", "at", F.explode(F.sequence(first, last)).alias("block"))
    skip = F.greatest(F.lit(0), F.col("block") * b - F.col("at"))
    end = F.least(F.col("size"), (F.col("block") + 1) * b - F.col("at"))
    return cut.select("row_id", "sid", "block", skip.alias("skip"), (end - skip).alias("n"))


def numbered(df: DataFrame, text: str = "text", source: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows with a ``row_id`` and their ``size``, stored once so that both stay as they are in every later job."""
    return stored(df.select(F.monotonically_increasing_id().alias("row_id"), F.col(source).alias("source"),
                            n_words(F.col(text)).alias("size"), *keep), "mix-rows")


def plan(docs: DataFrame, mix: Mix = Mix()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sources, slots, and the pieces of the documents in each block, of ``numbered`` documents."""
    of = stored(sources(docs, mix), "mix-sources")
    return of, slots(of, mix), streams(docs, of, mix)


def taken(df: DataFrame, mix: Mix = Mix(), text: str = "text", source: str = "source", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row: ``size``, ``source_size``, ``target`` of its source, and ``taken``, the words of it that the mix holds.

    Null and empty texts have size 0 and nothing is taken; a null source is a source of its own, the last one.  Repeated rows
    count one by one.  An empty table gives an empty result.  Columns other than ``carry`` are left out.
    """
    # the names under way must not clash with carried ones
    inner = tuple(F.col(c).alias(f"_c{i}") for i, c in enumerate(carry))
    docs = numbered(df, text, source, inner)
    of, slot, pieces = plan(docs, mix)
    uses = slot.groupBy("sid", "block").agg(F.count("*").alias("uses"))
    # the slots grow with the documents, which an estimate from the sources does not show
    sums = pieces.join(uses.hint("merge"), ["sid", "block"]).groupBy("row_id").agg(F.sum(F.col("n") * F.col("uses")).alias("taken"))
    rows = docs.join(of.select("source_size", "target", F.col("source").alias("_source")), F.col("source").eqNullSafe(F.col("_source")))
    return (rows.join(sums, "row_id", "left")
            .select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)), "size", "source_size", "target",
                    F.coalesce("taken", F.lit(0).cast("bigint")).alias("taken")))


def stretches(text: Column, runs: Column) -> Column:
    """The words of a text that sorted runs of ``skip`` and ``n`` take, with the white space between words that both are taken.

    Each word is cut out with the white space behind it, which goes where the next word is not taken.
    """
    def stretch(r: Column, i: Column, w: Column, all_runs: Column) -> Column:
        part = F.array_join(F.slice(w, (r["skip"] + 1).cast("int"), r["n"].cast("int")), "")
        following = F.get(all_runs, i + 1)
        bare = F.regexp_replace(part, r"[\x20\x09-\x0D]+$", "")
        return (F.when(following.isNull(), bare).when(following["skip"] == r["skip"] + r["n"], part)
                .otherwise(F.concat(bare, F.lit(" "))))

    cut = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    return bind(cut, lambda w: F.array_join(F.transform(runs, lambda r, i: stretch(r, i, w, runs)), ""))


def mixed_documents(df: DataFrame, mix: Mix = Mix(), text: str = "text", source: str = "source") -> DataFrame:
    """The mix as documents: one row per document and pass over its source, with the words that the pass takes.

    A document whose blocks are all taken keeps its text as it is; otherwise its text is the stretches between the first and
    last word of each run of taken blocks, white space inside them as it was, joined by a blank.  A document without words is no
    part of a mix.  The columns are those of the input.
    """
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row"))
    docs = numbered(rows.select("_row", F.col(f"_row.`{text}`").alias("_text"), F.col(f"_row.`{source}`").alias("_source")),
                    "_text", "_source", (F.col("_row"),))
    _, slot, pieces = plan(docs, mix)
    runs = (pieces.join(slot.select("sid", "block", "pass").hint("merge"), ["sid", "block"]).groupBy("row_id", "pass")
            .agg(F.array_sort(F.collect_list(F.struct("skip", "n"))).alias("runs"), F.sum("n").alias("n_taken")))
    old = F.col(f"_row.`{text}`")
    new = F.when(F.col("n_taken") == F.col("size"), old).otherwise(stretches(old, F.col("runs")))
    out = docs.join(runs, "row_id").select("_row", new.alias("_new"))
    return out.select(*(F.col("_new").alias(c) if c == text else F.length("_new").cast("bigint").alias(c) if c == "n_chars"
                        else F.col(f"_row.`{c}`").alias(c) for c in df.columns))
