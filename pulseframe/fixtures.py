"""The generated tables seen as the domain's tables, in Spark and in SQL. Times are microseconds in `t`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def micros(time: Column) -> Column:
    """Microseconds since 1970 of a wall-clock time, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), time.cast("timestamp_ntz"))


def wall_clock(t: Column) -> Column:
    return F.timestamp_add("MICROSECOND", t, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    return read(spark, sf_dir, "events").where(F.col("event_type").isin(*kinds)).withColumn("t", micros(F.col("ts"))).withColumn("user", (F.col("user_id") % 16).cast("long"))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir, "click", "view")
    return e.select(F.col("user").alias("user_id"), F.when(F.col("event_type") == "click", "hr").otherwise("steps").alias("data_type"), "t", "value")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir, "purchase")
    return e.select(F.col("user").alias("user_id"), F.col("event_id").alias("reading_id"), "t", (100 + F.floor("value") % 60).cast("long").alias("systolic"), (60 + F.col("event_id") % 40).cast("long").alias("diastolic"))


def stress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir, "error").select(F.col("user").alias("user_id"), "t", (1 + F.col("event_id") % 5).cast("long").alias("stress"))


def self_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir, "signup")
    substance = F.element_at(F.array(*[F.lit(x) for x in ("melon", "nectarine", "carrot", "almond")]), (F.col("event_id") % 4 + 1).cast("int"))
    scenario = F.element_at(F.array(*[F.lit(x) for x in ("Crave", "Use", "None")]), (F.col("event_id") % 3 + 1).cast("int"))
    return e.select(F.col("user").alias("user_id"), "event_id", "t", substance.alias("substance"), scenario.alias("scenario"))


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = read(spark, sf_dir, "lineitem")
    return x.select(
        F.col("l_suppkey").alias("user_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("sample_id"), F.col("l_linenumber").cast("long").alias("round"),
        F.when(F.col("l_linestatus") == "O", "test").otherwise("val").alias("split"), (F.col("l_returnflag") == "R").cast("long").alias("y_true"),
        F.round(F.col("l_discount") * 5 + F.col("l_tax") * 5, 4).alias("y_score"),
    )


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = read(spark, sf_dir, "embeddings")
    return x.select("vec_id", (F.col("vec_id") % 16).cast("long").alias("user_id"), F.col("embedding").cast("array<double>").alias("z"), F.col("label").cast("long").alias("cluster"), (F.col("label") < 4).cast("long").alias("state_val"), (F.col("vec_id") % 25 == 0).alias("labeled"))


#: The same tables as common table expressions, for the SQL of the queries.
WITH = """WITH signals AS (
  SELECT user_id % 16 AS user_id, CASE event_type WHEN 'click' THEN 'hr' ELSE 'steps' END AS data_type, epoch_us(ts) AS t, value
  FROM events WHERE event_type IN ('click', 'view')),
readings AS (
  SELECT user_id % 16 AS user_id, event_id AS reading_id, epoch_us(ts) AS t,
         CAST(100 + CAST(floor(value) AS BIGINT) % 60 AS BIGINT) AS systolic, 60 + event_id % 40 AS diastolic
  FROM events WHERE event_type = 'purchase'),
stress AS (
  SELECT user_id % 16 AS user_id, epoch_us(ts) AS t, 1 + event_id % 5 AS stress FROM events WHERE event_type = 'error'),
self_reports AS (
  SELECT user_id % 16 AS user_id, event_id, epoch_us(ts) AS t,
         (['melon', 'nectarine', 'carrot', 'almond'])[event_id % 4 + 1] AS substance, (['Crave', 'Use', 'None'])[event_id % 3 + 1] AS scenario
  FROM events WHERE event_type = 'signup'),
preds AS (
  SELECT l_suppkey AS user_id, l_orderkey * 10 + l_linenumber AS sample_id, CAST(l_linenumber AS BIGINT) AS round,
         CASE WHEN l_linestatus = 'O' THEN 'test' ELSE 'val' END AS split, CAST(l_returnflag = 'R' AS BIGINT) AS y_true,
         round(l_discount * 5 + l_tax * 5, 4) AS y_score
  FROM lineitem),
pool AS (
  SELECT vec_id, vec_id % 16 AS user_id, CAST(embedding AS DOUBLE[]) AS z, CAST(label AS BIGINT) AS cluster,
         CAST(label < 4 AS BIGINT) AS state_val, vec_id % 25 = 0 AS labeled FROM embeddings)
"""
