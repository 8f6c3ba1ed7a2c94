"""Writers: one folder for each type, split or group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .paths import written


def split_by_type(df: DataFrame, types: tuple[str, ...], out: str) -> None:
    """A folder below out for each of the types that occurs."""
    df.where(F.col("data_type").isin(*types)).write.partitionBy("data_type").parquet(out)


def safe_name(column: str):
    return F.regexp_replace(F.col(column), r"[^A-Za-z0-9_.-]+", "_")


def write_grouped(df: DataFrame, key: str, out: str) -> None:
    """CSV files below out, a folder for each group, named by the group with other characters replaced."""
    df.withColumn("_group", safe_name(key)).repartition("_group").write.partitionBy("_group").csv(out, header=True)


def replace_users(df: DataFrame, path: str, key: str = "user_id") -> None:
    """Write df into the stored aggregate at path, in place of what it holds of df's users; other users' rows stay.

    One folder for each user, replaced by dynamic overwriting when the job commits: a rerun leaves one copy. Columns may
    be missing on either side. Users without rows in df keep theirs.
    """
    df.repartition(key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def read_users(spark: SparkSession, path: str) -> DataFrame:
    """The stored aggregate, with the columns of all its files."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def write_splits(df: DataFrame, out: str, line: Column, key: str = "user_id") -> DataFrame:
    """Write df (user_id, day, split, ...) below out, a folder for each split, and its fingerprints; gives the latter.

    A day of a user in two splits is an error, and then nothing is written. Fingerprints are by user and split, over the
    sorted texts of `line`, in out/_fingerprints.
    """
    from ..operators.rollups import split_fingerprint

    df = written(df, "splits")
    shared = df.groupBy(key, "day").agg(F.countDistinct("split").alias("n")).where("n > 1").select(key, "day").limit(5).collect()
    if shared:
        raise ValueError(f"days in more than one split: {', '.join(f'{r[0]} {r[1]}' for r in shared)}")
    df.write.partitionBy("split").parquet(f"{out}/windows")
    split_fingerprint(df, [key, "split"], line).write.parquet(f"{out}/_fingerprints")
    return df.sparkSession.read.parquet(f"{out}/_fingerprints")
