"""Grid description texts: lines of ``key = value``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.columns import bind
from gridspark.operators.grid import POLE, Grid, coarsen_table

# Keys allowed in a grid description.
VALID_KEYS = (
    "gridtype", "gridsize", "xsize", "ysize", "xvals", "yvals", "nvertx", "xbounds", "ybounds", "xfirst", "xinc",
    "yfirst", "yinc", "xunits", "yunits", "xname", "yname", "xlongname", "ylongname", "grid_mapping",
    "grid_mapping_name", "grid_north_pole_latitude", "grid_north_pole_longitude")

SIZES = ("xsize", "ysize")
AXES = ("xfirst", "xinc", "yfirst", "yinc")


def parse_entries(lines: DataFrame, line: str = "value", keys: Sequence[str] = ()) -> DataFrame:
    """Key and value of every line with exactly one equals sign."""
    parts = F.split(F.col(line), "=")
    return lines.where(F.size(parts) == 2).select(
        *keys, F.trim(parts[0]).alias("key"), F.trim(parts[1]).alias("val"))


def parse_grids(lines: DataFrame, line: str = "value", keys: Sequence[str] = (), strict: bool = True) -> DataFrame:
    """One row per description with its sizes and axes, and the names of keys that are not allowed.

    With ``strict`` such keys are an error.
    """
    entries = parse_entries(lines, line, keys)
    known = F.col("key").isin(*VALID_KEYS)
    if strict:
        entries = entries.withColumn("key", F.when(known, F.col("key")).otherwise(
            F.raise_error(F.concat(F.lit("key not valid in a grid description: "), F.col("key"))).cast("string")))

    def entry(k, kind):
        return F.max(F.when(F.col("key") == k, F.col("val"))).try_cast(kind).alias(k)

    # the list of unknown keys of one description is as long as its text at most
    odd = F.array_sort(F.collect_set(F.when(~known, F.col("key")))).alias("invalid_keys")
    return entries.groupBy(*keys).agg(
        F.max(F.when(F.col("key") == "gridtype", F.col("val"))).alias("gridtype"),
        *[entry(k, "int") for k in SIZES], *[entry(k, "double") for k in AXES], odd)


# The mapping whose descriptions name a rotated pole, and the keys a coarse grid is made from.
ROTATED_MAPPING = "rotated_latitude_longitude"
REQUIRED = ("gridtype", *SIZES, *AXES)


def parse_texts(df: DataFrame, text: str = "value", strict: bool = True) -> DataFrame:
    """Each description text with ``entries``, all its keys and values in the order of the lines, and ``invalid_keys``.

    A line counts if it has exactly one equals sign.  A key that comes twice keeps its place and takes the last value.  With
    ``strict`` keys that are not allowed are an error.  A null text has no entries.  Nothing is shuffled.
    """
    parts = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), r"\r?\n"), lambda line: F.split(line, "="))
    pairs = F.transform(F.filter(parts, lambda p: F.size(p) == 2), lambda p: F.struct(F.trim(p[0]).alias("key"), F.trim(p[1]).alias("value")))
    read = df.withColumn("_pairs", pairs).withColumn("_keys", F.array_distinct(F.transform("_pairs", lambda p: p["key"])))
    last = F.transform("_keys", lambda k: F.struct(
        k.alias("key"), F.element_at(F.filter("_pairs", lambda p: p["key"] == k), -1)["value"].alias("value")))
    # only a text with a key that comes twice is searched for each of its keys
    entries = F.map_from_entries(F.when(F.size("_keys") == F.size("_pairs"), F.col("_pairs")).otherwise(last))
    odd = F.array_sort(F.array_except("_keys", F.array(*[F.lit(k) for k in VALID_KEYS])))
    if strict:
        entries = F.when(F.size(odd) == 0, entries).otherwise(F.raise_error(F.concat(
            F.lit("keys not valid in a grid description: "), F.array_join(odd, ", "))).cast("map<string,string>"))
    return read.withColumns({"entries": entries, "invalid_keys": odd}).drop("_pairs", "_keys")


def description_text(entries: Column) -> Column:
    """The text of a description again: a line per entry, in their order."""
    return F.array_join(F.transform(F.map_entries(entries), lambda e: F.concat(e["key"], F.lit(" = "), e["value"], F.lit("\n"))), "")


def with_axes(df: DataFrame) -> DataFrame:
    """Descriptions with sizes, axes and pole as columns, as cell tables take them; the pole only counts for its mapping."""
    def entry(key: str, kind: str) -> Column:
        return F.col("entries")[key].try_cast(kind)

    turned = F.col("entries")["grid_mapping_name"] == ROTATED_MAPPING
    return df.withColumns({k: entry(k, "int") for k in SIZES} | {k: entry(k, "double") for k in AXES}
                          | {k: F.when(turned, entry(k, "double")) for k in POLE})


def with_coarse(df: DataFrame, factor: int, extrapolate: bool = False, digits: int | None = None) -> DataFrame:
    """Descriptions with ``coarse`` and, unless extrapolating later, ``base``: entries like the source's, in its order and with all
    its keys, for the coarse grid and the padded one.

    Sizes, axes and, where it is there, ``gridsize`` are new.  ``digits`` rounds the axes of the source first.  Missing keys and
    sizes that do not divide are an error.
    """
    lost = F.filter(F.array(*[F.lit(k) for k in REQUIRED]), lambda k: ~F.map_contains_key("entries", k))
    checked = with_axes(df).withColumn("xsize", F.when(F.size(lost) == 0, F.col("xsize")).otherwise(F.raise_error(F.concat(
        F.lit("keys missing in a grid description: "), F.array_join(lost, ", "))).cast("int")))
    if digits is not None:
        checked = checked.withColumns({k: F.bround(k, digits) for k in AXES})
    made = coarsen_table(checked, factor, extrapolate)

    def new(kind: str, steps: str) -> Column:
        sizes = {k: F.col(f"{kind}_{k}").cast("string") for k in SIZES}
        sizes["gridsize"] = (F.col(f"{kind}_xsize") * F.col(f"{kind}_ysize")).cast("string")
        firsts = {k: F.round(f"{kind}_{k}", 10).cast("string") for k in ("xfirst", "yfirst")}
        values = sizes | firsts | {k: F.round(f"{steps}{k}", 10).cast("string") for k in ("xinc", "yinc")}
        names = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)])
        return bind(names, lambda n: F.map_from_entries(F.transform(F.map_entries("entries"), lambda e: F.struct(
            e["key"], F.coalesce(n[e["key"]], e["value"])))))

    kinds = {"coarse": new("coarse", "coarse_")} | ({} if extrapolate else {"base": new("base", "")})
    return made.withColumns(kinds).select(*df.columns, *kinds)


def read_grid(spark, path: str) -> Grid:
    """The grid of one description file, with its rotated pole if it has one."""
    row = with_axes(parse_texts(spark.read.text(path, wholetext=True))).first()
    pole = tuple(row[k] for k in POLE)
    return Grid(row["xsize"], row["ysize"], row["xfirst"], row["xinc"], row["yfirst"], row["yinc"], None if None in pole else pole)


def write_descriptions(df: DataFrame, path: str, key: str, entries: str = "entries") -> None:
    """One folder of text per description, with all its entries."""
    df.select(key, F.rtrim(description_text(F.col(entries)), F.lit("\n")).alias("value")).write.partitionBy(key).text(path)


def description_lines(grids: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Grid descriptions as lines of text again: rows ``(keys, line, value)``."""
    names = [c for c in grids.columns if c in VALID_KEYS]
    lines = F.array(*[F.concat(F.lit(f"{n} = "), F.col(n).cast("string")) for n in names])
    # a line is NULL where the description does not have the key
    return grids.select(*keys, F.posexplode(lines).alias("line", "value")).where(F.col("value").isNotNull())


def write_grids(grids: DataFrame, path: str, key: str) -> None:
    """One folder of text per description."""
    description_lines(grids, [key]).repartition(key).sortWithinPartitions(key, "line").select(key, "value").write.partitionBy(
        key).text(path)
