"""Language identification by interpolated Kneser-Ney models of characters.

A model per language gives the probability of a letter after the letters before it in its word.  The n-grams of all languages
share sorted arrays of hashes, with a row of probabilities per hash and a row of back-off weights per context, one column per
language, so that a letter is looked up once for all of them.  A text goes to the language with the lowest cross-entropy per
letter, and is rejected where that entropy is beyond what texts of the language have.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridspark.llm.batches import add_columns
from gridspark.llm.words import fold, picked, row_hash

ORDER = 4
#: Documents that the models are fitted on, over all languages: a bounded sample of the labelled rows.
FIT_DOCUMENTS = 6_000
LETTERS = re.compile(r"[^\W\d_]+")
START, STOP = "\x02", "\x03"
#: The quantile of a language's entropies that its limit starts from; the margin where there is no second language to leave out.
REJECT_SHARE, REJECT_MARGIN = 0.999, 1.5
BIN = 0.01  # nats a letter, of the counts that limits are taken from
UNDECIDED = "und"
FOLDS = 5  # fold 0 is held out


def letter_runs(text: str) -> list[str]:
    """Runs of letters in lower case."""
    return LETTERS.findall(text.lower())


_BASE = 0x9E3779B97F4A7C15


def _hashes(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """For each length k up to ``order``, the hash of the k codes that end at each place, with k mixed in."""
    out, h, power = [], np.zeros(len(codes), dtype=np.uint64), 1
    for k in range(order):
        moved = np.zeros(len(codes), dtype=np.uint64)
        moved[k:] = codes[:len(codes) - k] if k else codes
        h = h + (moved + np.uint64(1)) * np.uint64(power)
        power = power * _BASE % 2**64
        x = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(k)
        out.append(x ^ (x >> np.uint64(32)))
    return out


@dataclass
class LanguageModel:
    languages: list[str]
    keys: list[np.ndarray]       # per order: sorted hashes of the n-grams
    probs: list[np.ndarray]      # per order: natural logarithms, a row per n-gram, a column per language
    back_keys: list[np.ndarray]  # per order: sorted hashes of the contexts
    backs: list[np.ndarray]      # per order: logarithms of back-off weights
    floor: np.ndarray            # letters that no language has seen
    limits: np.ndarray           # entropy beyond which a language's texts are rejected
    errors: tuple[float, float] = (np.nan, np.nan)  # share of texts rejected; share of texts of a language left out that are not

    def entropies(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sums of -log p and numbers of letters (with the end) of each word: a row per word, a column per language."""
        text = "".join([START + w + STOP for w in words])
        codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
        size = np.fromiter((len(w) + 2 for w in words), dtype=np.int64, count=len(words))
        first = np.cumsum(size) - size
        inside = np.arange(len(codes)) - np.repeat(first, size)
        hashes = _hashes(codes, len(self.keys))
        logp = np.tile(self.floor, (len(codes), 1))
        todo = np.flatnonzero(inside > 0)  # the start itself is not scored
        top = len(self.keys)
        back = np.zeros((len(codes), len(self.languages)))
        for k in range(top - 1, -1, -1):
            able = todo[inside[todo] >= k]
            at = np.minimum(np.searchsorted(self.keys[k], hashes[k][able]), len(self.keys[k]) - 1)
            hit = self.keys[k][at] == hashes[k][able]
            found = able[hit]
            logp[found] = self.probs[k][at[hit]] + back[found]
            missed = able[~hit]
            if k == 0:
                logp[missed] = self.floor + back[missed]
                break
            context = hashes[k - 1][missed - 1]
            at = np.minimum(np.searchsorted(self.back_keys[k], context), len(self.back_keys[k]) - 1)
            known = self.back_keys[k][at] == context
            back[missed[known]] += self.backs[k][at[known]]
            todo = np.union1d(todo[inside[todo] < k], missed)
        logp[inside == 0] = 0
        # runs of digits of other scripts and the like hold no letter and count for nothing
        lettered = np.fromiter((any(map(str.isalpha, w)) for w in words), dtype=bool, count=len(words))
        return -np.add.reduceat(logp, first, axis=0) * lettered[:, None], (size - 1) * lettered

    def judge(self, sums: np.ndarray, letters: int) -> tuple[str, float, bool, float]:
        """Language, score, rejected and entropy of a text with such sums over its letters."""
        entropy = sums / letters
        best = int(np.argmin(entropy))  # the first in code-point order among equals
        gaps = np.minimum((entropy - entropy[best]) * min(letters, 100), 700)
        score = 1.0 / float(np.exp(-gaps).sum())
        over = float(entropy[best] - self.limits[best])
        if over > 0:
            score *= float(np.exp(-over))
        return self.languages[best], min(1.0, max(0.0, score)), over > 0, float(entropy[best])


def _kneser_ney(grams: dict[str, Counter], languages: list[str]) -> LanguageModel:
    """Models from counts of the n-grams of the highest order, per language.

    Words shorter than an n-gram begin with the start sign, so an n-gram that begins with it may be of a lower order; its
    counts stay counts, those of all others count the letters that come before.
    """
    tables: list[list[dict[str, float]]] = []   # per language, per order: probability of seen n-grams
    weights: list[list[dict[str, float]]] = []
    alphabet = sorted({g[-1] for lang in languages for g in grams[lang]})
    for lang in languages:
        counts: list[dict[str, int]] = [{} for _ in range(ORDER)]
        for g, c in grams[lang].items():
            counts[len(g) - 1][g] = c
        for k in range(ORDER - 1, 0, -1):
            # continuation counts of the next lower order: the different letters that precede it
            for g in counts[k]:
                counts[k - 1][g[1:]] = counts[k - 1].get(g[1:], 0) + 1
        prob: list[dict[str, float]] = []
        weight: list[dict[str, float]] = []
        uniform = 1.0 / (len(alphabet) + 1)
        for k in range(ORDER):
            of_counts = Counter(counts[k].values())
            once, twice = of_counts[1], of_counts[2]
            discount = once / (once + 2 * twice) if once and twice else 0.5
            total: Counter = Counter()
            kinds: Counter = Counter()
            for g, c in counts[k].items():
                total[g[:-1]] += c
                kinds[g[:-1]] += 1
            weight.append({h: discount * kinds[h] / total[h] for h in total})
            here: dict[str, float] = {}
            for g, c in counts[k].items():
                h = g[:-1]
                lower = prob[k - 1][g[1:]] if k else uniform
                here[g] = (c - discount) / total[h] + weight[k][h] * lower
            prob.append(here)
        tables.append(prob)
        weights.append(weight)

    def of(lang: int, gram: str) -> float:
        k = len(gram) - 1
        p = tables[lang][k].get(gram)
        if p is not None:
            return p
        lower = of(lang, gram[1:]) if k else 1.0 / (len(alphabet) + 1)
        return weights[lang][k].get(gram[:-1], 1.0) * lower

    keys, probs, back_keys, backs = [], [], [], []
    for k in range(1 + max(k for t in tables for k in range(ORDER) if t[k])):
        seen = sorted({g for t in tables for g in t[k]})
        h = _of_grams(seen, k)
        order = np.argsort(h)
        keys.append(h[order])
        probs.append(np.log(np.array([[of(n, g) for n in range(len(languages))] for g in seen]))[order])
        contexts = sorted({c for w in weights for c in w[k]})
        h = _of_grams(contexts, k - 1) if k else np.zeros(len(contexts), dtype=np.uint64)
        order = np.argsort(h)
        back_keys.append(h[order])
        backs.append(np.log(np.array([[w[k].get(c, 1.0) for w in weights] for c in contexts]))[order])
    floor = np.log(np.array([w[0].get("", 1.0) / (len(alphabet) + 1) for w in weights]))
    return LanguageModel(languages, keys, probs, back_keys, backs, floor, np.full(len(languages), np.inf))


def _of_grams(grams: list[str], k: int) -> np.ndarray:
    """Hashes of n-grams of k + 1 letters."""
    text = "".join(grams)
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    return _hashes(codes, k + 1)[k][k::k + 1].copy()


def _count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: dict[str, Counter] = {}
    for frame in frames:
        for text, lang in zip(frame["text"], frame["lang"]):
            words = Counter(letter_runs(text))
            into = counts.setdefault(lang, Counter())
            for word, n in words.items():
                marked = START + word + STOP
                for end in range(1, len(marked)):
                    into[marked[max(0, end - ORDER + 1):end + 1]] += n
    for lang, found in counts.items():
        yield pd.DataFrame({"lang": lang, "gram": list(found), "n": list(found.values())})


def fit(df: DataFrame, text: str = "text", lang: str = "lang", most: int = FIT_DOCUMENTS) -> LanguageModel:
    """Models from the labelled rows of ``df``.

    At most about ``most`` documents are fitted on, an equal number of each language, picked by a hash of the whole row, so that
    copies with ids of their own are picked one by one.  All other labelled rows, a tenth of the picked ones among them, set the
    limits of rejection.  Rows without a label or text are left out.  Without any, the model knows no language.
    """
    rows = df.select(F.col(text).alias("text"), F.col(lang).alias("lang"), row_hash(df).alias("hash")).where(
        "text IS NOT NULL AND lang IS NOT NULL")
    totals = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    pick = F.lit(False)  # stays so without labels
    for k, n in totals.items():
        pick = F.when(F.col("lang") == k, picked(F.col("hash"), most / len(totals) / n)).otherwise(pick)
    fitted = pick & (F.pmod(F.xxhash64("hash", F.lit(1)), F.lit(10)) != 0)
    counted = (rows.where(fitted).mapInPandas(_count, "lang string, gram string, n long")
               .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    grams: dict[str, Counter] = {k: Counter() for k in totals}
    # the n-grams of a bounded sample
    for r in counted.toLocalIterator(prefetchPartitions=True):
        grams[r["lang"]][r["gram"]] = r["n"]
    languages = sorted(k for k in totals if grams[k])
    if not languages:
        return LanguageModel([], [], [], [], [], np.zeros(0), np.zeros(0))
    model = _kneser_ney(grams, languages)
    _set_limits(model, rows.where(~fitted))
    return model


def _set_limits(model: LanguageModel, rows: DataFrame) -> None:
    """Limits and error rates from rows with ``text`` and ``lang`` that the model was not fitted on; equal texts count once.

    A limit is the quantile ``REJECT_SHARE`` of the language's own texts plus a margin, the same for all.  The margin has the lowest
    sum of two rates, each a mean over the languages: that of texts rejected, and that of texts not rejected when the model of
    their own language is left out.  The models do not depend on each other, so that one pass gives both.
    """
    shared, width = rows.sparkSession.sparkContext.broadcast(model), len(model.languages)

    def make():
        m = shared.value
        of = _summed(m)
        column = {x: i for i, x in enumerate(m.languages)}

        def run(texts, langs):
            best, entropy, other, left = [], [], [], []
            for (sums, letters), lang in zip(of(texts), langs):
                e = sums / letters if letters and lang in column else None
                k = int(np.argmin(e)) if e is not None else None
                best.append(k)
                entropy.append(None if e is None else float(e[k]))
                if e is not None and width > 1:
                    e[column[lang]] = np.inf
                    k = int(np.argmin(e))
                    other.append(k)
                    left.append(float(e[k]))
                else:
                    other.append(None)
                    left.append(None)
            return {"best": best, "entropy": entropy, "other": other, "left": left}
        return run

    kinds = {"best": T.IntegerType(), "entropy": T.DoubleType(), "other": T.IntegerType(), "left": T.DoubleType()}
    keyed = rows.select("text", "lang", F.xxhash64("text").alias("key"))
    judged = add_columns(keyed, ["text", "lang"], T.StructType([T.StructField(n, k) for n, k in kinds.items()]), make, ["lang", "key"])
    once = judged.where("best IS NOT NULL").groupBy("lang", "key").agg(*(F.min(c).alias(c) for c in kinds))
    sides = F.explode(F.array(F.struct(F.lit(True).alias("own"), F.col("best").alias("k"), F.floor(F.col("entropy") / BIN).alias("bin")),
                              F.struct(F.lit(False).alias("own"), F.col("other").alias("k"), F.floor(F.col("left") / BIN).alias("bin"))))
    # a row per pair of languages and bin, whatever the number of texts
    table = once.select("lang", sides.alias("s")).where("s.k IS NOT NULL").groupBy("lang", "s.own", "s.k", "s.bin").count().collect()
    found = [(model.languages.index(r["lang"]), r["own"], r["k"], r["bin"], r["count"]) for r in table]
    start = np.full(width, np.inf)
    for i in range(width):
        bins = sorted((b, n) for lang, own, k, b, n in found if own and lang == k == i)
        if bins:
            reached = np.cumsum([n for _, n in bins])
            start[i] = bins[int(np.searchsorted(reached, REJECT_SHARE * reached[-1]))][0]
    over = [(lang, own, b - start[k], n) for lang, own, k, b, n in found]
    ends = [x for _, _, x, _ in over if np.isfinite(x)]
    margin = round(REJECT_MARGIN / BIN)
    if ends:
        steps = np.arange(min(ends) - 1, max(ends) + 1)
        rejected, passed = _shares(over, True, steps), 1 - _shares(over, False, steps)
        if not np.isnan(passed).any():
            least = np.flatnonzero(rejected + passed <= (rejected + passed).min() + 1e-12)
            margin = steps[least[len(least) // 2]]
        at = int(np.clip(margin - steps[0], 0, len(steps) - 1))
        model.errors = float(rejected[at]), float(passed[at])
    model.limits = (start + 1 + margin) * BIN


def _shares(over: list[tuple], own: bool, steps: np.ndarray) -> np.ndarray:
    """Mean over the languages of the share of their texts that are beyond each step."""
    shares = []
    for lang in sorted({x[0] for x in over if x[1] == own}):
        d, n = (np.array(x, dtype=float) for x in zip(*((d, n) for i, o, d, n in over if i == lang and o == own)))
        order = np.argsort(d)
        below = np.r_[0, np.cumsum(n[order])][np.searchsorted(d[order], steps, side="right")]
        shares.append(1 - below / n.sum())
    return np.mean(shares, axis=0) if shares else np.full(len(steps), np.nan)


def _summed(m: LanguageModel):
    """A function of texts that gives the sums of -log p, a column per language, and the letters of each; it remembers words."""
    known: dict[str, int] = {}
    sums, sizes = [np.zeros((0, len(m.languages)))], [np.zeros(0, dtype=np.int64)]

    def run(texts: list[str | None]) -> Iterator[tuple[np.ndarray, int]]:
        if len(known) > 400_000:
            known.clear()
            sums[:], sizes[:] = [np.zeros((0, len(m.languages)))], [np.zeros(0, dtype=np.int64)]
        runs = [letter_runs(t) if t else [] for t in texts]
        new = list({w for r in runs for w in r if w not in known})
        for at in range(0, len(new), 20_000):
            part = new[at:at + 20_000]
            a, b = m.entropies(part)
            sums.append(a)
            sizes.append(b)
            known.update(zip(part, range(len(known), len(known) + len(part))))
        if len(sums) > 1:
            sums[:], sizes[:] = [np.concatenate(sums)], [np.concatenate(sizes)]
        for r in runs:
            at = np.fromiter(map(known.__getitem__, r), dtype=np.int64, count=len(r))
            yield sums[0][at].sum(axis=0), int(sizes[0][at].sum())
    return run


def score(df: DataFrame, model: LanguageModel, text: str = "text", carry: list[str] | None = None,
          prefix: str = "") -> DataFrame:
    """Add ``lang_pred``, ``score`` (0 to 1), ``rejected`` and ``entropy`` (nats per letter) of each whole text.

    A model without languages knows no text.  A text that is null or holds no letter is ``und`` with score 0 and is rejected.  Equal texts have equal results; empty
    tables give empty results; columns of these names, put behind ``prefix``, are replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by the sample it was fitted on

    def make():
        m = shared.value
        of = _summed(m) if m.languages else (lambda texts: [(0, 0)] * len(texts))

        def run(texts):
            out = [m.judge(sums, letters) if letters and m.languages else (UNDECIDED, 0.0, True, 0.0) for sums, letters in of(texts)]
            return dict(zip(names, map(list, zip(*out))))
        return run

    names = [f"{prefix}{x}" for x in ("lang_pred", "score", "rejected", "entropy")]
    kinds = (T.StringType(), T.DoubleType(), T.BooleanType(), T.DoubleType())
    return add_columns(df, [text], T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)]), make, carry)


def training_rows(df: DataFrame, doc_id: str = "doc_id", folds: int = FOLDS) -> DataFrame:
    """The rows outside fold 0; a row without an id is in none and is left out."""
    return df.where(fold(F.col(doc_id), folds) != 0)


def keep_identified(df: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """The rows whose text is in one of the languages, with the columns they came with."""
    return score(df, model, text, prefix="_lid_").where("NOT _lid_rejected").select(*(f"`{c}`" for c in df.columns))
