"""Quality rules: one table of thresholds compiled into one projection of built-in functions.

The stop words are those of four languages; a text in another language fails that rule, so leave it out of the rules there.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.llm.words import bind, packed, unpacked, unused, words

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "for", "it", "with", "as", "on", "at", "by", "be", "this", "are", "was", "or",
    "from", "le", "la", "les", "et", "des", "est", "dans", "une", "un", "qui", "pour", "pas", "sur", "au", "avec", "du", "que",
    "de", "en", "der", "die", "und", "den", "das", "von", "ist", "nicht", "mit", "auf", "sich", "ein", "dem", "eine", "im", "zu",
    "el", "los", "las", "y", "se", "del", "por", "con", "una", "para")


@dataclass(frozen=True)
class Rule:
    """A document is kept while ``low <= metric <= high``; without ``high`` there is no upper bound."""
    name: str
    metric: str
    low: float
    high: float | None = None


RULES = (
    Rule("words", "n_words", 50),
    Rule("mean_word", "mean_word_chars", 2.5, 12.0),
    Rule("symbols", "symbol_ratio", 0.0, 0.2),
    Rule("exclamations", "exclamation_ratio", 0.0, 0.5),
    Rule("letters", "letter_word_ratio", 0.7, 1.0),
    Rule("stop_words", "n_stop_words", 2),
    Rule("duplicate_lines", "dup_line_ratio", 0.0, 0.5),
    Rule("repeats", "repeat_ratio", 0.0, 0.5),
)


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _covered(starts: Column, width: int) -> Column:
    """Number of positions that windows of ``width`` at the sorted ``starts`` cover."""
    gaps = F.zip_with(starts, F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1))),
                      lambda a, b: F.least(F.lit(width), F.coalesce(b - a, F.lit(width))))
    return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda total, x: total + x)


def repeated_words(w: Column, width: int = 3) -> Column:
    """Words inside windows of ``width`` words that occur twice or more; ``w`` must be a bound array.

    Most texts repeat no window, which their hashes tell; only for the others are the windows sorted with their positions.
    """
    last = F.size(w) - width
    hashes = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(w[i + k] for k in range(width))))

    def starts(s: Column) -> Column:
        twice = F.filter(s, lambda x, j: (x["h"] == F.get(s, j - 1)["h"]) | (x["h"] == F.get(s, j + 1)["h"]))
        return F.array_sort(F.transform(twice, lambda x: x["p"]))

    def count(h: Column) -> Column:
        placed = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p")))
        return (F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint"))
                 .otherwise(bind(F.sort_array(placed), lambda s: bind(starts(s), lambda p: _covered(p, width)))))

    return F.when(last < 1, F.lit(0).cast("bigint")).otherwise(bind(hashes, count))


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the metrics of the rules; a null text has no words.  Every row is measured by itself, so repeated
    rows and empty tables need no special case.  Columns of these names are replaced."""
    t = F.coalesce(F.col(text), F.lit(""))

    def counts(w: Column) -> Column:
        # a line that holds anything but white space has a word
        lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        return F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
            F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
            (F.length(t) - F.length(F.replace(t, F.lit("!")))).cast("bigint").alias("n_exclamations"),
            bind(lines, lambda x: F.struct(F.size(x).cast("bigint").alias("n"),
                                           (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("dup"))).alias("lines"),
            F.size(F.filter(w, lambda x: x.rlike(r"\p{L}"))).cast("bigint").alias("n_letter_words"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))).cast("bigint").alias("n_stop_words"),
            repeated_words(w).alias("n_repeat_words"))

    held = unused(df, "_m")
    m = df.withColumn(held, bind(words(F.col(text)), counts))
    n = F.col(f"{held}.n_words")
    return m.withColumns({
        "n_words": n,
        "word_chars": F.col(f"{held}.word_chars"),
        "n_symbols": F.col(f"{held}.n_symbols"),
        "n_dup_lines": F.col(f"{held}.lines.dup"),
        "n_repeat_words": F.col(f"{held}.n_repeat_words"),
        "mean_word_chars": _ratio(F.col(f"{held}.word_chars"), n),
        "symbol_ratio": _ratio(F.col(f"{held}.n_symbols"), n),
        "exclamation_ratio": _ratio(F.col(f"{held}.n_exclamations"), n),
        "letter_word_ratio": _ratio(F.col(f"{held}.n_letter_words"), n),
        "n_stop_words": F.col(f"{held}.n_stop_words"),
        "dup_line_ratio": _ratio(F.col(f"{held}.lines.dup"), F.col(f"{held}.lines.n")),
        "repeat_ratio": _ratio(F.col(f"{held}.n_repeat_words"), n),
    }).drop(held)


def _beyond(r: Rule) -> Column:
    low = F.col(r.metric) < r.low
    return low if r.high is None else low | (F.col(r.metric) > r.high)


def judge(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Metrics, ``base_failed``, ``kept`` and ``failed_rules`` (names joined by commas) of each row.

    Null and empty texts have no words and fail the base rule.  Each row is judged by its text alone, so repeated rows,
    ties and empty tables need no special case; a column of the input that has the name of a result is replaced by it.
    """
    m = measure(df, text)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    failed = F.concat_ws(",", *(F.when(_beyond(r), F.lit(r.name)) for r in rules))
    return (m.withColumns({"base_failed": base, "failed_rules": failed})
            .withColumn("kept", ~F.col("base_failed") & (F.col("failed_rules") == "")))


def keep_good(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows that pass, with the columns they came with."""
    judged = judge(df.select(packed(df.columns), F.col(f"`{text}`").alias("_text")), "_text", rules)
    return judged.where("kept").select(*unpacked(df.columns))


def _bound(r: Rule) -> str:
    # ratios are doubles on both sides, so the bounds must be too
    low = f"{r.metric} < CAST({r.low!r} AS DOUBLE)"
    return low if r.high is None else f"{low} OR {r.metric} > CAST({r.high!r} AS DOUBLE)"


def oracle_sql(rules: tuple[Rule, ...] = RULES) -> str:
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    failed = ", ".join(f"CASE WHEN {_bound(r)} THEN '{r.name}' END" for r in rules)
    return f"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text FROM documents),
t AS (SELECT row_id, doc_id, text,
             list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
u AS (SELECT row_id, unnest(generate_series(1, len(w) - 2)) AS i, w FROM t WHERE len(w) > 2),
g AS (SELECT row_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM u),
r AS (SELECT row_id, i FROM (SELECT row_id, i, count(*) OVER (PARTITION BY row_id, a, b, c) AS n FROM g) WHERE n > 1),
p AS (SELECT row_id, count(DISTINCT i + k) AS n FROM r, (VALUES (0), (1), (2)) v(k) GROUP BY row_id),
m AS (SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words,
             CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
             CAST(len(regexp_extract_all(text, '!')) AS BIGINT) AS n_exclamations,
             CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, len(l) AS n_lines,
             len(list_filter(w, lambda x: regexp_matches(x, '\\p{{L}}'))) AS n_letter_words,
             len(list_filter(list_transform(w, lambda x: lower(x)), lambda x: x IN ({stop}))) AS n_stop_words,
             CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words
      FROM t LEFT JOIN p USING (row_id)),
q AS (SELECT *, CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0.0 END AS mean_word_chars,
             CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0.0 END AS symbol_ratio,
             CASE WHEN n_words > 0 THEN n_exclamations / n_words ELSE 0.0 END AS exclamation_ratio,
             CASE WHEN n_words > 0 THEN n_letter_words / n_words ELSE 0.0 END AS letter_word_ratio,
             CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0.0 END AS dup_line_ratio,
             CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0.0 END AS repeat_ratio FROM m),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, concat_ws(',', {failed}) AS failed_rules FROM q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND failed_rules = '' AS kept, failed_rules
FROM f"""
