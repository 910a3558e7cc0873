"""Columns that read facts out of variable names, level ids and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Variable types of a predictor dictionary.
VARIABLE_TYPES = ("sf", "ml", "fc_sf", "fc_pl")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def natural_key(path: Column, position: int = 0) -> Column:
    """First (or a later) integer in the base name, so that file 10 comes after file 9."""
    return F.get(F.regexp_extract_all(basename(path), F.lit(r"(\d+)"), F.lit(1)), F.lit(position)).try_cast("bigint")


def experiment_id(path: Column) -> Column:
    """Text between ``id`` and the next underscore."""
    return F.regexp_extract(basename(path), "id([^_]*)_", 1)


def shape_of(path: Column) -> Column:
    """Integers after ``_s_`` in a name such as ``pred_s_8_16_phys.dat``."""
    stem = F.element_at(F.split(F.replace(path, F.lit("_phys.dat"), F.lit(".dat")), r"\."), -2)
    return F.split(F.element_at(F.split(stem, "_s_"), -1), "_").cast("array<int>")


def level_name(variable: Column, pascal: Column) -> Column:
    """``t`` on 85000 Pa is the column ``t850``."""
    return F.concat(variable, F.floor(pascal / 100).cast("int").cast("string"))


def pressure_levels(ids: Column) -> Column:
    """Distinct Pa values of level ids such as ``p85000``; any other id is an error."""
    odd = F.filter(ids, lambda x: ~x.startswith("p"))
    levels = F.transform(ids, lambda x: F.ltrim(x, F.lit("p")).cast("double").cast("int"))
    failed = F.raise_error(F.concat(F.lit("level ids that are no pressure levels: "), F.array_join(odd, ", ")))
    return F.when(F.size(odd) > 0, failed.cast("array<int>")).otherwise(F.array_sort(F.array_distinct(levels)))


def predictor_rows(df, text: str, keep=()):
    """One row per (type, variable, level) of a JSON predictor dictionary; an unknown type is an error."""
    kind = F.when(F.col("vartype").isin(*VARIABLE_TYPES), F.col("vartype")).otherwise(
        F.raise_error(F.concat(F.lit("unknown variable type: "), F.col("vartype"))).cast("string"))
    parsed = F.from_json(text, "map<string, map<string, array<string>>>")
    return (df.select(*keep, F.explode(parsed).alias("vartype", "vars"))
            .select(*keep, kind.alias("vartype"), F.explode("vars").alias("variable", "levels"))
            .select(*keep, "vartype", "variable", F.explode_outer("levels").alias("level")))
