"""Sample building and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspark.catalog.fixtures import view_d, view_h
from gridspark.catalog.q_reshape import STIME
from gridspark.catalog.registry import hash_sql, query, r, rd, sts, ts
from gridspark.operators import normalize, samples
from gridspark.plans.training import prepare_samples
from gridspark.session import scratch_dir
from gridspark.sources.tables import write_monthly
from gridspark.streaming import ingest


def _steps(spark, sf_dir):
    """Time steps with their year as the group of files they come from."""
    return view_d(spark, sf_dir).select(F.year("time").alias("group_id"), "time").distinct()


STEPS = "SELECT DISTINCT year(time) AS group_id, time FROM D"


@query("file_groups", f"""
WITH M AS (SELECT DISTINCT strftime(time, '%Y%m%d') AS day FROM D), N AS (SELECT count(*) AS n FROM M),
S AS (SELECT d AS size FROM (SELECT unnest(range(1, n + 1)) AS d, n FROM N) WHERE n % d = 0 ORDER BY abs(d - 20), d LIMIT 1)
SELECT day, CAST(floor((rn - 1) / size) AS BIGINT) AS group_id, size AS group_size
FROM (SELECT day, row_number() OVER (ORDER BY {hash_sql("'42'", 'day')}, day) AS rn FROM M), S""")
def file_groups(spark, sf_dir):
    files = view_d(spark, sf_dir).select(F.date_format("time", "yyyyMMdd").alias("day"))
    return samples.file_groups(files, 20, on="day").drop("rn")


@query("pad_groups", f"""
WITH R AS (SELECT m, time, row_number() OVER (PARTITION BY m ORDER BY time) AS rn FROM (
  SELECT DISTINCT date_trunc('month', time) AS m, time FROM D)),
G AS (SELECT m, max(rn) AS n, max(time) AS last FROM R GROUP BY m),
S AS (SELECT *, (SELECT max(n) FROM G) - n AS missing FROM G WHERE n < (SELECT max(n) FROM G)),
W AS (SELECT *, CAST(floor(CAST({hash_sql("'42'", "strftime(m, '%Y-%m')")} AS DOUBLE) / 4294967296
  * (greatest(n - missing, 0) + 1)) AS BIGINT) AS start, unnest(range(missing)) AS j FROM S)
SELECT strftime(m, '%Y-%m') AS group_id, {sts()} AS time, false AS padded, {sts()} AS source_time FROM R
UNION ALL
SELECT strftime(w.m, '%Y-%m'), {sts('w.last + to_days(CAST(j + 1 AS INT))')}, true, {sts('r.time')}
FROM W w JOIN R r ON r.m = w.m AND r.rn = (w.start + w.j) % w.n + 1""")
def pad_groups(spark, sf_dir):
    months = view_d(spark, sf_dir).select(F.date_format("time", "yyyy-MM").alias("group_id"), "time").distinct()
    df = samples.pad_groups(months)
    return df.select("group_id", ts().alias("time"), "padded", ts("source_time").alias("source_time"))


BATCH = f"""SELECT group_id, time, row_number() OVER (PARTITION BY group_id ORDER BY {hash_sql("'42'", 'group_id', sts())}, time) - 1 AS p,
  count(*) OVER (PARTITION BY group_id) AS n FROM ({STEPS})"""


@query("minibatch", f"""
SELECT group_id, {sts()} AS time, CAST(floor(p / 16) AS BIGINT) AS batch_id, CAST(floor(p % 16 / 8) AS BIGINT) AS sub_step
FROM ({BATCH}) WHERE floor(p / 16) < floor(n / 16)""")
def minibatch(spark, sf_dir):
    df = samples.minibatch(_steps(spark, sf_dir), 8, d_steps=1, drop_remainder=True)
    return df.select("group_id", ts().alias("time"), "batch_id", "sub_step")


@query("epochs", f"""
SELECT epoch, group_id, {sts()} AS time, row_number() OVER (PARTITION BY epoch, group_id
  ORDER BY {hash_sql("'42'", 'epoch', 'group_id', sts())}, s.time) AS step
FROM ({STEPS}) s, (SELECT unnest([0, 1, 2]) AS epoch)""")
def epochs(spark, sf_dir):
    return samples.epochs(_steps(spark, sf_dir), 3).select("epoch", "group_id", ts().alias("time"), "step")


@query("shard", f"""
SELECT {STIME}, {r('t_in')} AS t_in FROM D JOIN (SELECT time AS s, row_number() OVER (ORDER BY time) AS rn
  FROM (SELECT DISTINCT time FROM D)) ON s = time WHERE (rn - 1) % 4 = 1""")
def shard(spark, sf_dir):
    df = samples.shard(view_d(spark, sf_dir), 1, 4)
    return df.select(ts().alias("time"), "iy", "ix", rd("t_in").alias("t_in"))


TRAIN = "SELECT avg(t_in) AS m1, stddev_pop(t_in) AS s1, avg(t_tar) AS m2, stddev_pop(t_tar) AS s2 FROM D WHERE year(time) <= 1999"


@query("prepare_samples", f"""
WITH T AS ({TRAIN}), B AS (SELECT time AS bt, floor(p / 32) AS batch_id FROM ({BATCH}) WHERE group_id = 2000)
SELECT {STIME}, CAST(batch_id AS BIGINT) AS batch_id, {r('CAST((t_in - m1) / s1 AS FLOAT)', 4)} AS t_in,
  {r('CAST((t_tar - m2) / s2 AS FLOAT)', 4)} AS t_tar FROM D JOIN B ON bt = time, T""")
def prepare(spark, sf_dir):
    d = view_d(spark, sf_dir).withColumn("group_id", F.year("time"))
    _, stats = prepare_samples(d.where("group_id <= 1999"), "train", ["t_in"], ["t_tar"], 32)
    val, _ = prepare_samples(d.where("group_id = 2000"), "val", ["t_in"], ["t_tar"], 32, stats=stats)
    return val.select(ts().alias("time"), "iy", "ix", "batch_id", *[rd(F.col(c).cast("double"), 4).alias(c)
                                                                    for c in ("t_in", "t_tar")])


@query("stream_normalize", f"""
WITH T AS ({TRAIN})
SELECT {STIME}, {r('CAST((t_in - m1) / s1 AS FLOAT)', 4)} AS t_in, {r('CAST((t_tar - m2) / s2 AS FLOAT)', 4)} AS t_tar FROM D, T""")
def stream_normalize(spark, sf_dir):
    base = scratch_dir(spark, "stream")
    d = view_d(spark, sf_dir).select("time", "iy", "ix", "t_in", "t_tar")
    write_monthly(d, f"{base}/source")
    stored = spark.read.parquet(f"{base}/source")
    stats = normalize.zscore_stats(stored.where("year <= 1999"), ["t_in", "t_tar"])
    # 22 files are loaded together
    ingest.stream_normalize(spark, f"{base}/source", d.schema, stats, ["t_in", "t_tar"], f"{base}/sink",
                            f"{base}/checkpoint", files_per_step=22).awaitTermination()
    return spark.read.parquet(f"{base}/sink").select(
        ts().alias("time"), "iy", "ix", *[rd(F.col(c).cast("double"), 4).alias(c) for c in ("t_in", "t_tar")])


@query("stream_error_budget", f"""
WITH V AS (SELECT *, CASE WHEN hour(time) = 5 THEN true ELSE ref_ > 150 END AS bad FROM H)
SELECT CAST(year(time) AS INT) AS year, CAST(month(time) AS INT) AS month, count(*) FILTER (WHERE bad) AS n_bad,
  count(*) FILTER (WHERE NOT bad) AS n_good, count(DISTINCT time) FILTER (WHERE bad) AS n_failed,
  {r('avg(ref_) FILTER (WHERE NOT bad)')} AS mean_good FROM V GROUP BY ALL""")
def stream_error_budget(spark, sf_dir):
    base = scratch_dir(spark, "budget")
    # values of one hour are missing, so their check has no answer
    h = view_h(spark, sf_dir).withColumn("checked", F.when(F.hour("time") != 5, F.col("ref_")))
    # many files per month and step, as they arrive
    h.repartitionByRange(6, "time").write.parquet(f"{base}/in")
    ingest.stream_with_budget(spark, f"{base}/in", h.schema, F.col("checked") > 150, f"{base}/good", f"{base}/checkpoint",
                              max_warn=1_000_000, files_per_step=2).awaitTermination()
    month = {"year": F.year("time"), "month": F.month("time")}
    pieces = spark.read.parquet(f"{base}/good_failed").groupBy("time").agg(F.sum("n_bad").alias("n_bad"), F.sum("n_good").alias("n_good"))
    counts = pieces.withColumns(month).groupBy("year", "month").agg(
        F.sum("n_bad").alias("n_bad"), F.sum("n_good").alias("n_good"), F.count_if(F.col("n_bad") > 0).alias("n_failed"))
    good = spark.read.parquet(f"{base}/good").withColumns(month).groupBy("year", "month").agg(rd(F.avg("ref_")).alias("mean_good"))
    return counts.join(good, ["year", "month"], "left")
