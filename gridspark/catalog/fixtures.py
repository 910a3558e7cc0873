"""Grid fields derived from the given tables, in Spark and as SQL views with the same rows.

E: dense 8x8 fields from embedding vectors, the next vector being the forecast.
H: hourly 3x4 fields with gaps from events.  L: the same with five pressure levels.
D: daily 3x4 fields of several years from line items.  Z: a static field.  F: file names with dates.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.functions.calendar import hour_start
from gridspark.operators.grid import Grid

GRID_E = Grid(8, 8, 6.0, 0.5, 48.0, 0.5)
# pressure in Pa of each event type in L
LEVELS = {"click": 50000, "view": 70000, "purchase": 85000, "error": 92500, "signup": 100000}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cell(key: str) -> list:
    c = F.col(key) % 12
    return [F.floor(c / 4).cast("int").alias("iy"), (c % 4).cast("int").alias("ix")]


def e_rows(df: DataFrame, field: str, t: str = "t", value: str = "value") -> DataFrame:
    """Arrays of 64 values as cells of an 8x8 grid."""
    rows = df.select(t, F.posexplode(field).alias("p", "v"))
    return rows.select(t, F.floor(F.col("p") / 8).cast("int").alias("iy"), (F.col("p") % 8).cast("int").alias("ix"),
                       F.col("v").cast("double").alias(value))


def view_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    now = emb.select(F.col("vec_id").alias("t"), F.col("embedding").alias("r"))
    nxt = emb.select((F.col("vec_id") - 1).alias("t"), F.col("embedding").alias("f"))
    # vectors are joined whole and only then taken apart
    rows = now.join(nxt, "t").select("t", F.posexplode(F.arrays_zip("f", "r")).alias("p", "v"))
    return rows.select("t", F.floor(F.col("p") / 8).cast("int").alias("iy"), (F.col("p") % 8).cast("int").alias("ix"),
                       F.col("v.f").cast("double").alias("fcst"), F.col("v.r").cast("double").alias("ref_")).withColumns(
        {"lat": 48.0 + 0.5 * F.col("iy"), "lon": 6.0 + 0.5 * F.col("ix")})


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single events with forecast and reference values."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("double")
    return table(spark, sf_dir, "events").select(
        hour_start(F.col("ts")).alias("time"), (F.col("user_id") % 12).cast("int").alias("cell"), *_cell("user_id"),
        "event_type", k.alias("fcst"), F.col("value").alias("ref_"))


def view_h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("time", "cell", "iy", "ix").agg(
        F.avg("fcst").alias("fcst"), F.avg("ref_").alias("ref_"))


def view_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.lit(None).cast("int")
    for kind, pa in LEVELS.items():
        level = F.when(F.col("event_type") == kind, pa).otherwise(level)
    return events(spark, sf_dir).withColumn("level", level).where(F.col("level").isNotNull()).groupBy(
        "time", "iy", "ix", "level").agg(F.avg("ref_").alias("t"))


def view_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").alias("time"), *_cell("l_suppkey")).agg(
        F.avg(q * (1 + F.col("l_discount") - F.col("l_tax"))).alias("t_in"),
        F.avg("l_extendedprice").alias("p_in"), F.avg(q).alias("t_tar"))


def view_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").groupBy(*_cell("s_suppkey")).agg(F.avg("s_acctbal").alias("z"))


def view_f(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", F.concat(
        F.lit("sfc_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_"),
        F.lpad((F.col("o_orderkey") % 24).cast("string"), 2, "0"), F.lit(".nc")).alias("fname"))


def _level_case() -> str:
    return "CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in LEVELS.items()) + " END"


VIEWS = {
    "EB": """SELECT vec_id, CAST(floor(p / 8) AS INT) AS iy, CAST(p % 8 AS INT) AS ix, CAST(v AS DOUBLE) AS val
  FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS p FROM embeddings)""",
    "E": """SELECT a.vec_id AS t, a.iy, a.ix, 48.0 + 0.5 * a.iy AS lat, 6.0 + 0.5 * a.ix AS lon,
  b.val AS fcst, a.val AS ref_
  FROM EB a JOIN EB b ON b.vec_id = a.vec_id + 1 AND b.iy = a.iy AND b.ix = a.ix""",
    "H": """SELECT date_trunc('hour', ts) AS time, CAST(user_id % 12 AS INT) AS cell,
  CAST(floor((user_id % 12) / 4) AS INT) AS iy, CAST((user_id % 12) % 4 AS INT) AS ix,
  avg(CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE)) AS fcst, avg(value) AS ref_
  FROM events GROUP BY ALL""",
    "L": f"""SELECT date_trunc('hour', ts) AS time, CAST(floor((user_id % 12) / 4) AS INT) AS iy,
  CAST((user_id % 12) % 4 AS INT) AS ix, {_level_case()} AS level, avg(value) AS t
  FROM events WHERE {_level_case()} IS NOT NULL GROUP BY ALL""",
    "D": """SELECT l_shipdate AS time, CAST(floor((l_suppkey % 12) / 4) AS INT) AS iy,
  CAST((l_suppkey % 12) % 4 AS INT) AS ix, avg(l_quantity * (1 + l_discount - l_tax)) AS t_in,
  avg(l_extendedprice) AS p_in, avg(l_quantity) AS t_tar FROM lineitem GROUP BY ALL""",
    "Z": """SELECT CAST(floor((s_suppkey % 12) / 4) AS INT) AS iy, CAST((s_suppkey % 12) % 4 AS INT) AS ix,
  avg(s_acctbal) AS z FROM supplier GROUP BY ALL""",
    "F": """SELECT o_orderkey, o_orderdate, concat('sfc_', strftime(o_orderdate, '%Y%m%d'), '_',
  lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0'), '.nc') AS fname FROM orders""",
}
NEEDS = {"E": ["EB"]}


def with_views(sql: str) -> str:
    """The SQL with the definitions of the views it names in front."""
    used: list[str] = []
    for name in VIEWS:
        if re.search(rf"(?:FROM|JOIN|,)\s+{name}\b", sql):
            used += [n for n in [*NEEDS.get(name, []), name] if n not in used]
    if not used:
        return sql
    views = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in used)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        raise ValueError("recursive SQL is not needed here")
    if body.upper().startswith("WITH "):
        return f"WITH {views},\n{body[5:]}"
    return f"WITH {views}\n{body}"
