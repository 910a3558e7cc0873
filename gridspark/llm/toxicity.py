"""Toxicity scores by a logistic model that is held still under swaps of identity terms.

Features are words and beginnings of words, each at one, two and three or more places.  Spark counts them per label and the
telling ones are kept.  The model is fitted with a penalty on the change of its output when the identity terms of a text are
swapped for others of their kind, so that naming a group moves a score little.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridspark.llm.batches import add_columns
from gridspark.llm.words import Memo, memo_key, picked as in_share, row_hash
from gridspark.session import stored

RUNS = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6)
LEVELS = 3
#: The sample the model is fitted on, per label, and the features it may have.
FIT_ROWS, FIT_FEATURES = 5_000, 4_000
LEAST_Z = 4.0
SWAP_PENALTY, RIDGE, STEPS = 2.0, 1e-3, 400
THRESHOLD = 0.3

# Identity terms by kind; a term is swapped for the next of its kind.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girl", "boy"), ("female", "male"), ("gay", "straight"), ("lesbian", "heterosexual"),
    ("black", "white", "asian", "latino"), ("african", "european", "american", "mexican", "chinese", "indian", "arab"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("immigrant", "native", "refugee"), ("immigrants", "natives", "refugees"), ("disabled", "blind", "deaf"), ("old", "young"),
    ("transgender", "cisgender"), ("femmes", "hommes"), ("frauen", "männer"), ("mujeres", "hombres"),
    ("musulman", "chrétien", "juif"), ("moslem", "christ", "jude"), ("musulmán", "cristiano", "judío"))
SWAPS = {term: kind[(n + 1) % len(kind)] for kind in IDENTITY_TERMS for n, term in enumerate(kind)}


def features(word: str) -> tuple[str, ...]:
    """The word itself and its beginnings."""
    return (f"={word}", *(word[:n] for n in PREFIXES if len(word) >= n))


def levels(words: list[str]) -> Counter:
    """How often a text holds each feature, up to ``LEVELS``."""
    found: Counter = Counter()
    for word, n in Counter(words).items():
        for f in features(word):
            found[f] += n
    return found


def runs(text: str | None) -> list[str]:
    return RUNS.findall(text.lower()) if text else []


def swapped(words: list[str]) -> list[str] | None:
    """The words with identity terms swapped; none if there are no such terms."""
    return [SWAPS.get(w, w) for w in words] if not SWAPS.keys().isdisjoint(words) else None


def inserted(words: list[str]) -> tuple[list[str], list[str]]:
    """Two forms of a sentence without identity terms: with a term, and with its counterpart, at the same place.

    A hash of the sentence picks kind, term and place.
    """
    h = memo_key(" ".join(words).encode())
    kind = IDENTITY_TERMS[h % len(IDENTITY_TERMS)]
    term, place = kind[(h >> 16) % len(kind)], (h >> 32) % (len(words) + 1)
    return [*words[:place], term, *words[place:]], [*words[:place], SWAPS[term], *words[place:]]


@dataclass
class Model:
    """Weights of features by level, ``weights[i, l]`` being added where feature i stands at more than l places.

    ``pairs`` says how many counterfactual pairs the fit has held together: by swapped terms and by inserted ones.
    """
    names: dict[str, int]
    weights: np.ndarray
    bias: float
    pairs: tuple[int, int] = (0, 0)

    def score(self, words: list[str], of: Memo | None = None) -> float:
        of = of if of is not None else Memo(self.known)
        counts: dict[int, int] = {}
        for found in filter(None, map(of.__getitem__, words)):
            for i in found:
                counts[i] = counts.get(i, 0) + 1
        total = self.bias + sum(float(self.weights[i, :n].sum()) for i, n in sorted(counts.items()))
        return float(1.0 / (1.0 + np.exp(-np.clip(total, -30, 30))))

    def known(self, word: str) -> tuple[int, ...]:
        return tuple(self.names[f] for f in features(word) if f in self.names)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts per label that hold each feature at each level, over the rows of a task."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for batch in batches:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
            counts[label].update((f, level) for f, n in levels(runs(text)).items() for level in range(min(n, LEVELS)))
    keys = sorted(counts[0].keys() | counts[1].keys())
    for at in range(0, len(keys), 50_000):
        part = keys[at:at + 50_000]
        yield pa.RecordBatch.from_pydict({
            "feature": pa.array([k[0] for k in part], pa.string()), "level": pa.array([k[1] for k in part], pa.int32()),
            "clean": pa.array([counts[0][k] for k in part], pa.int64()), "toxic": pa.array([counts[1][k] for k in part], pa.int64())})


def sample(rows: DataFrame, key: str, most: int = FIT_ROWS) -> tuple[DataFrame, dict[int, float]]:
    """About ``most`` rows per label at the most, picked by a hash of ``key``; and the share that each label keeps."""
    totals = {int(r["label"]): r["count"] for r in rows.groupBy("label").count().collect()}
    share = {k: min(1.0, most / n) for k, n in totals.items()}
    hashed = F.xxhash64(key)
    return rows.where(F.when(F.col("label") == 1, in_share(hashed, share.get(1, 1.0))).otherwise(in_share(hashed, share.get(0, 1.0)))), share


def fit(df: DataFrame, text: str = "text", label: str = "toxic", most: int = FIT_ROWS, penalty: float = SWAP_PENALTY,
        share: dict[int, float] | None = None) -> Model:
    """A model from the labelled rows of ``df``; rows without a label are left out, a null text is an empty one.

    A sample is drawn unless ``share`` says which share of each label ``df`` already is.  Nothing but the text is an input.  With no toxic row or no clean one the model gives every text the share of the labels.
    """
    rows = df.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(label).cast("int").alias("label"), row_hash(df).alias("hash"))
    rows = rows.where("label IN (0, 1)")
    picked, share = sample(rows, "hash", most) if share is None else (rows, share)
    picked = stored(picked, "toxic-sample")
    sizes = {int(r["label"]): r["count"] for r in picked.groupBy("label").count().collect()}
    n_clean, n_toxic = sizes.get(0, 0), sizes.get(1, 0)
    all_toxic, all_clean = n_toxic / share.get(1, 1.0), n_clean / share.get(0, 1.0)
    bias = float(np.log((all_toxic + 0.5) / (all_clean + 0.5)))
    if not n_clean or not n_toxic:
        return Model({}, np.zeros((0, LEVELS)), bias)
    counted = (picked.mapInArrow(_count, "feature string, level int, clean long, toxic long")
               .groupBy("feature", "level").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")))
    p, q = F.col("toxic") / n_toxic, F.col("clean") / n_clean
    both = (F.col("toxic") + F.col("clean") + 1) / (n_toxic + n_clean + 2)
    z = F.abs(p - q) / F.sqrt(both * (1 - both) * (1 / n_toxic + 1 / n_clean))
    telling = (counted.where((F.col("toxic") + F.col("clean") >= 3) & (z >= LEAST_Z)).groupBy("feature").agg(F.max(z).alias("z"))
               .orderBy(F.desc("z"), "feature").limit(FIT_FEATURES))
    names = {r["feature"]: i for i, r in enumerate(telling.collect())}
    # identity terms always take part, so that the penalty reaches them
    for term in SWAPS:
        names.setdefault(f"={term}", len(names))
    width = len(names)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def indices(words: list[str]) -> list[int]:
            return sorted(names[f] * LEVELS + level for f, n in levels(words).items() if f in names for level in range(min(n, LEVELS)))
        for batch in batches:
            out = []
            for t in batch.column("text").to_pylist():
                words = runs(t)
                other = swapped(words)
                pair = (words, other) if other else inserted(words)
                out.append((indices(words), indices(pair[0]), indices(pair[1]), bool(other)))
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_pydict({"label": batch.column("label"), "x": pa.array([o[0] for o in out], kind),
                                              "one": pa.array([o[1] for o in out], kind), "other": pa.array([o[2] for o in out], kind),
                                              "swapped": pa.array([o[3] for o in out])})

    # a bounded sample over a bounded number of features
    data = picked.mapInArrow(rows_of, "label int, x array<int>, one array<int>, other array<int>, swapped boolean")
    data = data.orderBy("label", "x", "one", "other").toPandas()
    y = data["label"].to_numpy(dtype=np.float64)
    weight = np.where(y == 1, 1 / share.get(1, 1.0), 1 / share.get(0, 1.0))
    weights, bias = _train(data["x"].tolist(), list(zip(data["one"], data["other"])), y, weight / weight.mean(), width * LEVELS, bias, penalty)
    n_swapped = int(data["swapped"].sum())
    return Model(names, weights.reshape(width, LEVELS), bias, (n_swapped, len(data) - n_swapped))


def _train(x: list, pairs: list, y: np.ndarray, weight: np.ndarray, width: int, bias: float, penalty: float) -> tuple[np.ndarray, float]:
    """Weights that minimise log loss + penalty * (change within a pair)**2 + ridge, by scaled gradient steps."""
    flat, size = np.concatenate([np.asarray(r, dtype=np.int64) for r in x]), np.array([len(r) for r in x])
    row = np.repeat(np.arange(len(x)), size)
    change = [(np.asarray(a, dtype=np.int64), np.asarray(b, dtype=np.int64)) for a, b in pairs]
    c_flat = np.concatenate([np.concatenate(c) for c in change]) if change else np.zeros(0, dtype=np.int64)
    c_sign = np.concatenate([np.r_[np.ones(len(a)), -np.ones(len(b))] for a, b in change]) if change else np.zeros(0)
    c_row = np.repeat(np.arange(len(pairs)), [len(a) + len(b) for a, b in change]) if change else np.zeros(0, dtype=np.int64)
    w, seen, seen_bias, n = np.zeros(width), np.full(width, 1e-8), 1e-8, len(x)
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(row, weights=w[flat], minlength=n), -30, 30)))
        r = weight * (p - y) / n
        g = np.bincount(flat, weights=r[row], minlength=width) + RIDGE * w / n ** 0.5
        if len(pairs):
            moved = np.bincount(c_row, weights=c_sign * w[c_flat], minlength=len(pairs))
            g += 2 * penalty / len(pairs) * np.bincount(c_flat, weights=c_sign * moved[c_row], minlength=width)
        seen += g * g
        seen_bias += r.sum() ** 2
        w -= 0.3 * g / np.sqrt(seen)
        bias -= 0.3 * r.sum() / np.sqrt(seen_bias)
    return w, float(bias)


def score(df: DataFrame, model: Model, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Add ``score``, the probability of the label 1, and ``predicted``, 1 from ``THRESHOLD`` on, of each whole text.

    Null and empty texts have the score of no features.  Equal texts have equal scores; empty tables give empty results; columns
    of these names are replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by FIT_FEATURES

    def make():
        m = shared.value
        of = Memo(m.known, 500_000)

        def run(texts):
            scores = [m.score(runs(t), of) for t in texts]
            return {"score": scores, "predicted": [int(s >= THRESHOLD) for s in scores]}
        return run

    new = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return add_columns(df, [text], new, make, carry)


def labelled(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = FIT_ROWS) -> tuple[DataFrame, dict[int, float]]:
    """Texts with the label of their document, at most about ``most`` per label, and the share that each label keeps.

    A document with several labels counts as toxic if one says so; null labels and labels of unknown documents are left out.  The
    sample is drawn from the labels, so that it is the labels that are sent to the texts, and no text is moved.
    """
    one = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label"))
    picked, share = sample(one, "doc_id", most)
    # not more than two times ``most`` ids
    met = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    return met.select("doc_id", "text", F.col("label").alias(label)), share
