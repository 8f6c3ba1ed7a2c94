"""Picking rows to label: by uncertainty, at random, by day; rounds of picking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..hashing import hash_key, with_position
from ..sources.paths import scratch


def margin_score(scores: DataFrame) -> DataFrame:
    return scores.withColumn("uncertainty", F.round(1 - F.abs(2 * F.col("y_score") - 1), 6))


def topk(df: DataFrame, score: str, key: str, k: int) -> DataFrame:
    """The k largest scores (to 9 places), ties to smaller keys; taken partition by partition, without a full sort."""
    return df.orderBy(F.round(score, 9).desc(), key).limit(k)


def margin_topk(scores: DataFrame, k: int, key: str = "sample_id") -> DataFrame:
    return topk(margin_score(scores), "uncertainty", key, k)


def top_fraction(df: DataFrame, score: str, key: str, frac: float, least: int) -> DataFrame:
    """The max(least, ceil(frac * n)) largest scores, ties at the cut by key. Rows are ranked inside score buckets."""
    ranked = with_position(df, [], -F.floor(F.col(score) * 1000), [F.col(score).desc(), F.col(key)])
    return ranked.where(F.col("_position") <= F.greatest(F.lit(least), F.ceil(frac * F.col("_position_n")))).select(*df.columns)


def random_k(pool: DataFrame, k: int, seed: int, key: str) -> DataFrame:
    return pool.orderBy(hash_key(seed, key), key).limit(k)


def k_per_day(pool: DataFrame, k: int, seed: int, key: str) -> DataFrame:
    """k rows (or all) of each user's day, in hash order."""
    rank = F.row_number().over(W.partitionBy("user_id", "day").orderBy(hash_key(seed, key), key))
    return pool.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def unlabeled_pool(pool: DataFrame, labeled: DataFrame, key: str) -> DataFrame:
    return pool.join(labeled.select(key), key, "left_anti")


def ordered_rounds(pool: DataFrame, order: list, k: int, rounds: int, key: str) -> DataFrame:
    """key, round: the rows that `rounds` rounds of k picks take in a fixed order; closed form of the loop."""
    first = pool.orderBy(*order, key).limit(k * rounds)
    rank = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*order, key))  # k * rounds rows at most
    return first.select(key, F.ceil(rank / k).cast("long").alias("round"))


def random_rounds(pool: DataFrame, k: int, rounds: int, seed: int, key: str) -> DataFrame:
    return ordered_rounds(pool.select(key, hash_key(seed, key).alias("_h")), [F.col("_h")], k, rounds, key)


def score_rounds(pool: DataFrame, score: str, k: int, rounds: int, key: str) -> DataFrame:
    """Rounds of the largest scores where scores stay as they are."""
    return ordered_rounds(pool, [F.round(score, 9).desc()], k, rounds, key)


def coreset_picks(key: str, vector: str, k: int):
    """For active_learning_rounds: the rows farthest from what is labelled."""
    from .vectors import coreset_greedy

    return lambda left, labeled, r: left.join(coreset_greedy(labeled, left, k, key, vector).select(key), key, "left_semi")


def kmeans_picks(key: str, vector: str, k: int):
    """For active_learning_rounds: the rows nearest to centres that start from the labelled centroid."""
    from .vectors import kmeans_query

    return lambda left, labeled, r: left.join(kmeans_query(labeled, left, k, key, vector).select(key), key, "left_semi")


def active_learning_rounds(
    pool: DataFrame, labeled: DataFrame, pick: Callable[[DataFrame, DataFrame, int], DataFrame], k: int, rounds: int, key: str, state: str | None = None, scorer: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """key, round of the rows picked. pick(unlabeled, labeled, round) returns at most k rows of unlabeled.

    scorer(df) gets the pool with queried_round (0: labelled at first, null: unlabelled) before each round and gives it
    back with scores for pick, whose labelled rows are dropped again. Each round's picks are appended to the round table
    below `state` (a folder of the shared file system; a new one if None). A run that was killed goes on from the last
    round that was written whole, and rounds that are there are not picked again; an exhausted pool ends the rounds.
    """
    spark = pool.sparkSession
    state = state or scratch(spark, "rounds")
    kind = dict(pool.dtypes)[key]
    start = labeled.select(key, F.lit(0).cast("long").alias("round")).distinct()
    done = rounds_done(spark, state)
    table = lambda: spark.read.schema(f"`{key}` {kind}, round long").parquet(*[f"{state}/{r:06d}" for r in range(1, done + 1)]) if done else spark.createDataFrame([], f"`{key}` {kind}, round long")
    for r in range(done + 1, rounds + 1):
        known = start.unionByName(table()).withColumnRenamed("round", "queried_round")
        rows = pool.join(known, key, "left")
        scored = scorer(rows) if scorer else rows
        left, have = scored.where("queried_round is null").drop("queried_round"), rows.where("queried_round is not null").drop("queried_round")
        new = pick(left, have, r).limit(k).select(key, F.lit(r).cast("long").alias("round"))
        new.write.mode("overwrite").parquet(f"{state}/{r:06d}")  # what a killed run left of this round goes
        if spark.read.schema(new.schema).parquet(f"{state}/{r:06d}").isEmpty():
            break
        done = r
    return table().where(F.col("round") <= rounds)


def rounds_done(spark: SparkSession, state: str) -> int:
    """How many rounds, from the first on, are written whole below state."""
    jvm, done = spark._jvm, 0
    while True:
        mark = jvm.org.apache.hadoop.fs.Path(f"{state}/{done + 1:06d}/_SUCCESS")
        if not mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
            return done
        done += 1


def score_picks(score: str, k: int, key: str):
    """For active_learning_rounds: the k largest scores as a scorer gives them anew."""
    return lambda left, labeled, r: topk(left, score, key, k)


def user_counts(picked: DataFrame, pool: DataFrame, key: str) -> DataFrame:
    """round, user_id, n: how many of each user's rows a round picked."""
    return picked.join(pool.select(key, "user_id"), key).groupBy("round", "user_id").agg(F.count(F.lit(1)).alias("n"))


def round_log(picked: DataFrame, labeled_before: int, total: int) -> DataFrame:
    """round, new, num_labeled, pct_total_labeled."""
    c = picked.groupBy("round").agg(F.count(F.lit(1)).alias("new"))
    running = F.sum("new").over(W.partitionBy(F.lit(0)).orderBy("round")) + labeled_before  # a row for each round
    return c.select("round", "new", running.alias("num_labeled"), (100.0 * running / total).alias("pct_total_labeled"))
