"""Near-duplicate documents by an inverted join of MinHash signatures.

A document is the set of its five-word shingles; two are linked when their sets overlap by three quarters or more.  Signatures
of ``SIZE`` coordinates propose links: documents are posted under each pair of coordinate and value, and a pair of documents
is a candidate when it collides in ``MATCHES`` coordinates.  At a similarity of 0.75 fewer collide with probability below 1e-6.

* Prefix: with the postings of a document in order of rising frequency, two documents that collide ``MATCHES`` times meet in
  the first ``SIZE - MATCHES + 1`` of both.  The most frequent postings, those of shared passages, are never joined.
* Skip: pairs whose set sizes rule the similarity out are skipped before collisions are counted over whole signatures.
* Groups of copies: equal sets are one node.  In a list each node is first paired with two centres only, the one whose
  coordinates are shared most and a random one.  Only pairs in different components are left then, and a node can be in one
  only if enough of its shingles stand in nodes of other components; the others are peeled off.  What is left is joined on its
  rare shared shingles.  So large groups of near copies and common passages do not expand into all pairs, and no link between
  components is lost.

Candidates are confirmed on the full sets.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridspark.llm.batches import add_columns
from gridspark.llm.components import components
from gridspark.llm.words import Memo, memo_key, packed, unpacked
from gridspark.session import stored

WIDTH, SIZE, MATCHES = 5, 64, 30
PREFIX = SIZE - MATCHES + 1
_STEP = 512


def _odd(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingles:
    """Sets of hashed shingles, as sorted 64-bit integers, and their signatures."""

    def __init__(self):
        self.memo = Memo(memo_key, 500_000)
        self.places = _odd(11, WIDTH)
        draws = np.random.default_rng(12)
        self.a = draws.integers(0, 2**32, SIZE, dtype=np.uint32) | np.uint32(1)
        self.b = draws.integers(0, 2**32, SIZE, dtype=np.uint32)

    def of(self, text: str | None) -> np.ndarray:
        # bytes.lower() and bytes.split() know ASCII letters and ASCII white space only, as is wanted
        words = (text or "").encode().lower().split()
        if not words:
            return np.zeros(0, dtype=np.uint64)
        memo = self.memo
        ids = np.array([memo[w] for w in words], dtype=np.uint64)
        n, k = max(1, len(ids) - WIDTH + 1), min(WIDTH, len(ids))
        sums = np.full(n, k, dtype=np.uint64)
        for j in range(k):
            sums += ids[j:j + n] * self.places[j]
        return np.unique(_mixed(sums))

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        high = (shingles >> np.uint64(32)).astype(np.uint32)
        least = np.full(SIZE, 2**32 - 1, dtype=np.uint32)
        for at in range(0, len(high), _STEP):
            np.minimum(least, (high[at:at + _STEP, None] * self.a + self.b).min(axis=0), out=least)
        return least.view(np.int32)


def signatures(df: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Add ``n_shingles``, ``digest`` (16 bytes that stand for the set) and ``signature`` (null for an empty set)."""
    def make():
        import xxhash

        work = Shingles()

        def run(texts):
            sets = [work.of(t) for t in texts]
            return {"n_shingles": [len(s) for s in sets], "digest": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets],
                    "signature": [work.signature(s) if len(s) else None for s in sets]}
        return run

    new = T.StructType([T.StructField("n_shingles", T.LongType()), T.StructField("digest", T.BinaryType()),
                        T.StructField("signature", T.ArrayType(T.IntegerType()))])
    return add_columns(df, [text], new, make, carry)


def _shingle_sets(df: DataFrame, text: str, carry: list[str]) -> DataFrame:
    def make():
        import xxhash

        work = Shingles()

        def run(texts):
            sets = [work.of(t) for t in texts]
            return {"digest": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], "shingles": [s.view(np.int64) for s in sets]}
        return run

    new = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("shingles", T.ArrayType(T.LongType()))])
    return add_columns(df, [text], new, make, carry)


def _similar_size(n: Column, m: Column) -> Column:
    return 4 * F.least(n, m) >= 3 * F.greatest(n, m)


def _lists(nodes: DataFrame) -> DataFrame:
    """The prefix postings of each node that another node shares: ``key``, ``node``, ``n`` and ``shared``."""
    posted = nodes.select("node", "n", F.posexplode("signature").alias("at", "value")).select(
        "node", "n", (F.shiftleft(F.col("at").cast("bigint"), 32) + F.col("value").cast("bigint") + 2**31).alias("key"))
    common = posted.groupBy("key").count().where("count > 1")
    met = posted.join(common, "key")
    rising = Window.partitionBy("node").orderBy("count", "key")
    whole = Window.partitionBy("node")
    # postings of the node alone come first in the order, so they use up the prefix first
    alone = SIZE - F.count("*").over(whole)
    ranked = met.select("key", "node", "n", (F.row_number().over(rising) + alone).alias("rank"),
                        F.sum(F.log("count")).over(whole).alias("shared"))
    return ranked.where(F.col("rank") <= PREFIX).drop("rank")


def _collide(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs ``a``, ``b`` that collide in ``MATCHES`` coordinates."""
    sig = nodes.select("node", "signature")
    met = (pairs.join(sig.select(F.col("node").alias("a"), F.col("signature").alias("sa")), "a")
           .join(sig.select(F.col("node").alias("b"), F.col("signature").alias("sb")), "b"))
    hits = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda total, x: total + x)
    return met.where(hits >= MATCHES).select("a", "b")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose full sets overlap by three quarters."""
    met = (pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
           .join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b"))
    both = met.select("a", "b", F.size(F.array_intersect("x", "y")).cast("bigint").alias("both"),
                      (F.size("x") + F.size("y")).cast("bigint").alias("all"))
    return both.where(100 * F.col("both") >= 75 * (F.col("all") - F.col("both"))).select("a", "b")


def _with_component(rows: DataFrame, found: DataFrame) -> DataFrame:
    return (rows.join(found, "node", "left")
            .withColumn("component", F.coalesce("component", "node")))


def _mixed_lists(lists: DataFrame) -> DataFrame:
    """Members of the lists that hold nodes of more than one component."""
    mixed = lists.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    return lists.join(mixed, "key", "left_semi")


def _held(members: DataFrame, sets: DataFrame) -> DataFrame:
    """The shingles of members that stand in nodes of other components too, with ``f``, how many nodes hold them."""
    held = members.join(sets, "node").select(*(members[c] for c in members.columns), F.explode("shingles").alias("s"))
    spread = (held.groupBy("s").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("f"))
              .where("lo < hi").select("s", "f"))
    return held.join(spread, "s")


def _peeled(lists: DataFrame, sets: DataFrame) -> DataFrame:
    """Members that can still be linked to another component.

    Sets of n and m shingles are linked from an overlap of 3 (n + m) / 7 on, and what a node shares with another component
    lies within the shingles that stand in others.  ``m`` is the size of the smallest member of the list that is large enough.
    Shingles are compared among the members of mixed lists, where every node that can still be linked is.
    """
    out = _held(lists.select("node", "component").distinct(), sets).groupBy("node").agg(F.count("*").alias("out"))
    # sizes down to three quarters, with room for rounding
    near = Window.partitionBy("key").orderBy("log_n").rangeBetween(-287_700, 0)
    sized = lists.drop("m").withColumn("log_n", F.floor(1_000_000 * F.log("n"))).withColumn("m", F.min("n").over(near)).drop("log_n")
    return sized.join(out, "node").where(7 * F.col("out") >= 3 * (F.col("n") + F.col("m"))).drop("out")


def _across(rest: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs ``a``, ``b`` of different components that may be linked, by a join on rare shared shingles.

    With the shingles that a node shares with other components in order of rising frequency, a linked pair meets in the first
    ones of both: those after which enough are left for the overlap that their sizes need.  The shingles that all near copies
    of a text hold come last, so a large group does not meet as a whole.
    """
    members = rest.groupBy("node", "n", "component").agg(F.min("m").alias("m"))
    rising = Window.partitionBy("node").orderBy("f", "s")
    whole = Window.partitionBy("node")
    left = (_held(members, sets).withColumn("left", F.count("*").over(whole) - F.row_number().over(rising) + 1)
            .where(7 * F.col("left") >= 3 * (F.col("n") + F.col("m"))).select("s", "node", "n", "component", "left"))
    left = stored(left, "dup-rare")
    mixed = left.groupBy("s").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("s")
    left = left.join(mixed, "s", "left_semi")
    x = left.select("s", F.col("node").alias("a"), F.col("n").alias("na"), F.col("component").alias("ca"), F.col("left").alias("la"))
    y = left.select("s", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("component").alias("cb"), F.col("left").alias("lb"))
    return (x.join(y, "s").where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & _similar_size(F.col("na"), F.col("nb"))
                                 & (7 * F.least("la", "lb") >= 3 * (F.col("na") + F.col("nb"))))
            .select("a", "b").distinct())


def links(nodes: DataFrame, texts: DataFrame, text: str = "text", peels: int = 2) -> DataFrame:
    """All confirmed links ``a``, ``b`` that decide the components of ``nodes`` (node, n, digest, text_hash, signature)."""
    lists = stored(_lists(nodes), "dup-lists")
    listed = lists.select("node").distinct()
    wanted = nodes.join(listed, "node", "left_semi").select("node", "digest", "text_hash")
    # a text is looked up by its hash, its set by the digest
    rows = texts.withColumn("text_hash", F.xxhash64(text)).join(wanted.select("text_hash").distinct(), "text_hash", "left_semi")
    sets = (_shingle_sets(rows.select(text), text, []).join(wanted.select("node", "digest"), "digest")
            .groupBy("node").agg(F.first("shingles").alias("shingles")))
    sets = stored(sets, "dup-sets")

    centre = lists.groupBy("key").agg(F.max(F.struct("shared", (-F.col("node")).alias("m"), "n")).alias("c1"),
                                      F.min(F.struct(F.xxhash64("key", "node").alias("h"), "node", "n")).alias("c2"))
    around = lists.join(centre, "key").select("node", "n", F.explode(F.array(
        F.struct((-F.col("c1.m")).alias("c"), F.col("c1.n").alias("m")), F.struct(F.col("c2.node").alias("c"), F.col("c2.n").alias("m")))).alias("x"))
    pairs = (around.where((F.col("node") != F.col("x.c")) & _similar_size(F.col("n"), F.col("x.m")))
             .select(F.least("node", "x.c").alias("a"), F.greatest("node", "x.c").alias("b")).distinct())
    first = stored(_confirmed(_collide(pairs, nodes), sets), "dup-links")

    rest = _mixed_lists(_with_component(lists, components(first)))
    for _ in range(peels):
        rest = _mixed_lists(_peeled(stored(rest, "dup-rest"), sets))
    return first.unionByName(stored(_confirmed(_collide(_across(stored(rest, "dup-rest"), sets), nodes), sets), "dup-links"))


def near_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row: ``doc_id``, ``n_shingles``, ``component_id`` (smallest id reachable) and ``kept``.

    A text with fewer than five words is one shingle; null and blank texts have none and are linked with nothing.  Rows with
    equal sets are one class, whatever their ids; repeated rows give repeated results.  A null id counts for nothing in
    ``component_id``: it is null where no id can be reached, and a row without an id is kept only there.
    """
    return _judged(df, text, doc_id).select("doc_id", "n_shingles", "component_id", "kept")


def _judged(df: DataFrame, text: str, doc_id: str) -> DataFrame:
    """What ``near_duplicates`` gives, with ``text_hash`` and ``component``, which is null where there are no shingles."""
    texts = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    rows = signatures(texts.withColumn("text_hash", F.xxhash64("text")), "text", ["doc_id", "text_hash"])
    rows = stored(rows.withColumn("row_id", F.monotonically_increasing_id()), "dup-rows")
    classes = rows.where("n_shingles > 0").groupBy("digest").agg(F.min("row_id").alias("node"), F.min("doc_id").alias("least"))
    classes = stored(classes, "dup-classes")
    nodes = (rows.select(F.col("row_id").alias("node"), F.col("n_shingles").alias("n"), "digest", "text_hash", "signature")
             .join(classes.select("node"), "node", "left_semi"))
    found = stored(components(links(nodes, texts)), "dup-components")
    named = _with_component(classes, found)
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of = named.join(ids, "component").select("digest", "component", "component_id")
    out = rows.select("doc_id", "n_shingles", "digest", "text_hash").join(of, "digest", "left")
    least = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", least.alias("component_id"), "text_hash",
                      F.when(F.col("n_shingles") > 0, F.col("component")).alias("component")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def one_of_each(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of each group, with the columns of ``df``.

    Ids name documents: of the rows that repeat a kept id one stays.  Of a group in which no row has an id one row stays, and of
    texts without shingles and id one per text.
    """
    bare = F.col("doc_id").isNull() & F.col("component").isNotNull()
    # rows are told apart by id and text, which stay as they are when the input is read again
    kept = (_judged(df, text, doc_id).where("kept").groupBy(F.col("doc_id").alias("kept"), F.when(bare, F.col("component")),
                                                            F.when(~bare, F.col("text_hash")))
            .agg(F.min("text_hash").alias("kept_hash")).select("kept", "kept_hash"))
    rows = df.select(packed(df.columns), F.col(f"`{doc_id}`").cast("bigint").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("hash"))
    met = rows.join(kept, F.col("id").eqNullSafe(F.col("kept")) & (F.col("hash") == F.col("kept_hash")), "left_semi")
    same = Window.partitionBy("id", F.when(F.col("id").isNull(), F.col("hash"))).orderBy("hash")
    return met.withColumn("nth", F.row_number().over(same)).where("nth = 1").select(*unpacked(df.columns))


ORACLE_SQL = """
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT DISTINCT r, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                                ELSE list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM d),
s AS (SELECT r, count(*) AS n FROM g GROUP BY r),
p AS (SELECT x.r AS a, y.r AS b, count(*) AS c FROM g x JOIN g y ON x.s = y.s AND x.r <> y.r GROUP BY x.r, y.r),
e AS (SELECT a, b FROM p JOIN s x ON x.r = a JOIN s y ON y.r = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
t(r, m) AS (SELECT r, r FROM d UNION SELECT t.r, e.b FROM t JOIN e ON e.a = t.m),
c AS (SELECT t.r, min(d.doc_id) AS component_id FROM t JOIN d ON d.r = t.m GROUP BY t.r)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, c.component_id,
       coalesce(d.doc_id = c.component_id, c.component_id IS NULL) AS kept
FROM d JOIN c USING (r) LEFT JOIN s USING (r)"""
