"""Licence scans by a positional index of rare words, with built-in functions only.

Templates are short licence notices.  The corpus says how rare each of their words is; the rarest word of a template is its
anchor, and the rarest other word that it must hold its second.  Postings say for each such word which templates have it where.
The rare words of a file are looked up in the postings, each putting templates at relative positions; the positions by anchors and
by seconds are intersected, and where both agree the mandatory phrases are verified and the other words compared.  Templates and
postings are a row of data, so the plan is the same for any number of them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridspark.llm.words import bind, unused

SPLIT = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LEAST_SHARE = 0.8


@dataclass(frozen=True)
class Template:
    """``phrases`` must stand word by word; ``base`` templates are phrases of their own and count their places."""
    label: str
    text: str
    phrases: tuple[str, ...] = ()
    base: bool = False

    @property
    def words(self) -> tuple[str, ...]:
        return tuple(self.text.split())


# Phrases with their labels, and the wording of common notices.
TEMPLATES = (
    Template("gpl", "gnu general public license", base=True),
    Template("apache", "apache license", base=True),
    Template("cc-by", "cc by", base=True),
    Template("mit", "mit license", base=True),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", ("general public license version 3",)),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", ("general public license version 2",)),
    Template("gpl-3.0", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license",
             ("gnu general public license as published by the free software foundation", "either version 3 of the license")),
    Template("gpl-2.0", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license",
             ("gnu general public license as published by the free software foundation", "either version 2 of the license")),
    Template("lgpl", "licensed under the gnu lesser general public license", ("lesser general public license",)),
    Template("agpl", "licensed under the gnu affero general public license", ("affero general public license",)),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2",)),
    Template("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4",)),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-nd-4.0", "licensed under cc by nd 4 0", ("cc by nd",)),
    Template("mit-notice", "released under the mit license", ("mit license",)),
    Template("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software",
             ("permission is hereby granted free of charge",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
             ("redistribution and use in source and binary forms",)),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose",
             ("permission to use copy modify",)),
)


def licence_words(text: Column) -> Column:
    """The words of a text as written, in order; a null text has none.  Only A-Z and a-z differ from the compared form."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPLIT), "")


def _plain(word: Column) -> Column:
    # lower() also folds a few letters outside ASCII into ASCII; words that hold such are left as they are
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(word)


def _vocabulary(templates: tuple[Template, ...]) -> list[str]:
    return sorted({w for t in templates for w in t.words})


def rarity(df: DataFrame, text: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> dict[str, float]:
    """Inverse document frequency of each word of the templates over all rows; one row per word comes back."""
    vocabulary = _vocabulary(templates)
    found = bind(licence_words(F.col(text)), lambda w: F.array_distinct(F.transform(F.filter(w, lambda x: F.lower(x).isin(*vocabulary)), _plain)))
    rows = df.agg(F.count("*")).first()[0]
    counts = df.select(F.explode(found).alias("w")).groupBy("w").count().where(F.col("w").isin(*vocabulary)).collect()
    df_of = {r["w"]: r["count"] for r in counts}
    return {w: round(math.log((1 + rows) / (1 + df_of.get(w, 0))) + 1, 9) for w in vocabulary}


def anchor(template: Template, idf: dict[str, float]) -> int:
    """Position of the rarest word of a template, the first among equals."""
    return max(range(len(template.words)), key=lambda k: (idf[template.words[k]], -k))


def _same(word: Column, wanted: Column) -> Column:
    """Whether a word equals an ASCII word in its compared form."""
    return F.coalesce((F.lower(word) == wanted) & (F.octet_length(word) == F.length(wanted)), F.lit(False))


def _offset(template: Template, phrase: str) -> int:
    words, part = template.words, tuple(phrase.split())
    return next(k for k in range(len(words)) if words[k:k + len(part)] == part)


def _held(t: Template) -> set[int]:
    """Positions of the words that must stand: those of the mandatory phrases, all of a base template."""
    return set(range(len(t.words))) if t.base else {k for p in t.phrases for k in range(_offset(t, p), _offset(t, p) + len(p.split()))}


def second(template: Template, first: int, idf: dict[str, float]) -> int | None:
    """Position of the rarest other word that must stand, if there is one."""
    return max(_held(template) - {first}, key=lambda k: (idf[template.words[k]], -k), default=None)


INDEX = T.StructType([
    T.StructField("postings", T.MapType(T.StringType(), T.ArrayType(T.StructType([
        T.StructField("t", T.IntegerType()), T.StructField("k", T.IntegerType()), T.StructField("role", T.IntegerType())])))),
    T.StructField("templates", T.ArrayType(T.StructType([
        T.StructField("label", T.StringType()), T.StructField("base", T.BooleanType()), T.StructField("total", T.DoubleType()),
        T.StructField("words", T.ArrayType(T.StructType([
            T.StructField("k", T.IntegerType()), T.StructField("w", T.StringType()), T.StructField("idf", T.DoubleType()),
            T.StructField("held", T.BooleanType())])))])))])
FIRST, SECOND, ALONE = 0, 1, 2


def index(templates: tuple[Template, ...], idf: dict[str, float]) -> tuple[dict, list]:
    """Postings of the anchors and seconds, and the templates with the rarity of their words."""
    postings: dict[str, list] = {}
    entries = []
    for n, t in enumerate(templates):
        first = anchor(t, idf)
        other = second(t, first, idf)
        postings.setdefault(t.words[first], []).append((n, first, FIRST if other is not None else ALONE))
        if other is not None:
            postings.setdefault(t.words[other], []).append((n, other, SECOND))
        held = _held(t)
        entries.append((t.label, t.base, float(sum(idf[x] for x in t.words)), [(k, w, idf[w], k in held) for k, w in enumerate(t.words)]))
    return postings, entries


def _stands(w: Column, words: Column, start: Column) -> Column:
    return F.forall(words, lambda x: ~x["held"] | _same(F.get(w, start + x["k"]), x["w"]))


def _share(w: Column, template: Column, start: Column) -> Column:
    """The share of the rarity of a template whose words stand in their places."""
    matched = F.aggregate(template["words"], F.lit(0.0), lambda total, x: total + F.when(
        _same(F.get(w, start + x["k"]), x["w"]), x["idf"]).otherwise(0.0))
    return F.round(matched / template["total"], 6)


def scan(df: DataFrame, text: str = "text", templates: tuple[Template, ...] = TEMPLATES, least_share: float = LEAST_SHARE,
         idf: dict[str, float] | None = None) -> DataFrame:
    """Add ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels`` and ``score``.

    A base template counts every place where its words stand consecutively.  Any other template is found where its anchor
    stands, its mandatory phrases stand at their relative positions, and its matched words have ``least_share`` of its
    rarity.  ``score`` is the largest share of a found template, the base ones at 1 and 0 where none is found.  Null and
    empty texts have no words, no labels and null positions; repeated rows are scanned each and an empty table gives none.
    Columns of these names are replaced.
    """
    idf = idf or rarity(df, text, templates)
    postings, entries = index(templates, idf)
    rare = df.sparkSession.createDataFrame([(postings, entries)], INDEX).select(F.struct("postings", "templates")).scalar()
    known, held = unused(df, "_index"), unused(df, "_m")

    def find(w: Column) -> Column:
        # places of rare words, few as these are the rarest of their templates
        places = F.filter(F.transform(w, lambda x, i: F.when(
            F.lower(x).isin(*sorted(postings)) & (F.octet_length(x) == F.length(x)), F.struct(i.alias("i"), F.lower(x).alias("w")))),
            lambda p: p.isNotNull())
        met = F.flatten(F.transform(places, lambda p: F.transform(F.element_at(F.col(f"{known}.postings"), p["w"]), lambda x: F.struct(
            x["t"].alias("t"), (p["i"] - x["k"]).alias("s"), x["role"].alias("role")))))
        return F.struct(F.size(w).cast("bigint").alias("n_words"), bind(met, lambda m: found(w, m)).alias("found"))

    def at(m: Column, role: int) -> Column:
        return F.transform(F.filter(m, lambda x: x["role"] == role), lambda x: F.struct(x["t"].alias("t"), x["s"].alias("s")))

    def found(w: Column, m: Column) -> Column:
        agreed = F.concat(F.array_intersect(at(m, FIRST), at(m, SECOND)), at(m, ALONE))
        named = F.transform(agreed, lambda c: F.struct(c["s"].alias("s"), F.get(F.col(f"{known}.templates"), c["t"]).alias("of")))
        standing = F.filter(named, lambda c: _stands(w, c["of"]["words"], c["s"]))
        return F.transform(standing, lambda c: F.struct(
            c["of"]["label"].alias("label"), c["of"]["base"].alias("base"), c["s"].alias("s"),
            F.when(c["of"]["base"], 1.0).otherwise(_share(w, c["of"], c["s"])).alias("share")))

    m = df.withColumn(known, rare).withColumn(held, bind(licence_words(F.col(f"`{text}`")), find))
    hits = F.filter(f"{held}.found", lambda c: c["base"] | (c["share"] >= least_share))
    base = F.filter(hits, lambda c: c["base"])
    starts = F.transform(base, lambda c: c["s"])
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda c: c["label"]))), ",")
    return m.withColumns({
        "n_words": F.col(f"{held}.n_words"),
        "n_base": F.size(starts).cast("bigint"),
        "first_word": F.array_min(starts).cast("bigint"),
        "last_word": F.array_max(starts).cast("bigint"),
        "base_labels": joined(base),
        "labels": joined(hits),
        "score": F.coalesce(F.array_max(F.transform(hits, lambda c: c["share"])), F.lit(0.0)),
    }).drop(held, known)


def oracle_sql(templates: tuple[Template, ...] = TEMPLATES, least_share: float = LEAST_SHARE) -> str:
    """The same result by joining all words with all words of the templates."""
    rows = ", ".join(f"({n}, '{t.label}', {str(t.base).lower()}, {k}, '{w}', {str(any(_offset(t, p) <= k < _offset(t, p) + len(p.split()) for p in t.phrases) or t.base).lower()})"
                     for n, t in enumerate(templates) for k, w in enumerate(t.words))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH tpl(t, label, base, k, w, needed) AS (VALUES {rows}),
d AS (SELECT row_number() OVER () AS row_id, doc_id, translate(coalesce(text, ''), '{upper}', '{lower}') AS text FROM documents),
l AS (SELECT row_id, doc_id, list_filter(regexp_split_to_array(text, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM d),
o AS (SELECT row_id, unnest(w) AS w, unnest(generate_series(0, len(w) - 1)) AS pos FROM l WHERE len(w) > 0),
df AS (SELECT w, count(DISTINCT row_id) AS n FROM o WHERE w IN (SELECT w FROM tpl) GROUP BY w),
idf AS (SELECT DISTINCT tpl.w, round(ln((1 + (SELECT count(*) FROM d)) / (1 + coalesce(n, 0))) + 1, 9) AS idf FROM tpl LEFT JOIN df USING (w)),
v AS (SELECT tpl.*, idf, sum(idf) OVER (PARTITION BY t) AS total, sum(needed::int) OVER (PARTITION BY t) AS n_needed,
             row_number() OVER (PARTITION BY t ORDER BY idf DESC, k) = 1 AS anchor FROM tpl JOIN idf USING (w)),
h AS (SELECT row_id, t, any_value(label) AS label, any_value(base) AS base, pos - k AS start, round(sum(idf) / any_value(total), 6) AS share,
             sum(needed::int) AS got, any_value(n_needed) AS n_needed, bool_or(anchor) AS anchored
      FROM o JOIN v USING (w) GROUP BY row_id, t, pos - k),
f AS (SELECT * FROM h WHERE anchored AND got = n_needed AND (base OR share >= {least_share})),
g AS (SELECT row_id, count(*) FILTER (WHERE base) AS n_base, min(start) FILTER (WHERE base) AS first_word,
             max(start) FILTER (WHERE base) AS last_word,
             list_sort(list_distinct(list(label) FILTER (WHERE base))) AS base_labels, list_sort(list_distinct(list(label))) AS labels,
             CASE WHEN count(*) FILTER (WHERE base) > 0 THEN 1.0 ELSE max(share) END AS score FROM f GROUP BY row_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
       CAST(last_word AS BIGINT) AS last_word, coalesce(array_to_string(base_labels, ','), '') AS base_labels,
       coalesce(array_to_string(labels, ','), '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM l LEFT JOIN g USING (row_id)"""
