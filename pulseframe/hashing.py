"""Hash order: the order in which every sampler of this library draws, stable under repartitioning and reruns."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def hash_key(seed: int, *keys: Column | str) -> Column:
    """md5 of 'seed:key:...' in hex; its ascending order is the drawing order."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]))


def hash_unit(seed: int, *keys: Column | str) -> Column:
    """A number in [0, 1): the first eight hex digits of the hash key."""
    return F.conv(F.substring(hash_key(seed, *keys), 1, 8), 16, 10).cast("double") / 4294967296.0


def hash_normal(seed: int, *keys: Column | str) -> Column:
    """A standard normal deviate by Box and Muller from two hash units."""
    u = F.greatest(hash_unit(seed, *keys, F.lit("a")), F.lit(1e-9))
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * 3.141592653589793 * hash_unit(seed, *keys, F.lit("b")))


#: Rows of a group that are numbered in one sort; larger groups go by buckets.
WHOLE = 65_536


def with_position(df: DataFrame, by: list[str], bucket: Column, order: list[Column | str], name: str = "_position") -> DataFrame:
    """df with name: the row number in each group `by` in the order of (bucket, *order), and <name>_n, the group's rows.

    bucket must rise with the order. A group of up to WHOLE rows is numbered as it is, so that many small groups do not
    make a table of buckets as long as their rows. In a larger one, rows are numbered inside their buckets and the
    buckets' counts are added up, so that it is many tasks. Groups and buckets with nulls are groups and buckets of their own.
    """
    if not by:
        return _by_buckets(df.withColumn("_whole", F.lit(0)), ["_whole"], bucket, order, name).drop("_whole")
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_count")).where(F.col("_count") > WHOLE)
    large = F.broadcast(sizes.select(*[F.col(c).alias(f"_l_{c}") for c in by]))  # at most a row for each WHOLE rows
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_l_{c}"))
    ordered = W.partitionBy(*by).orderBy(bucket, *order)
    whole = ordered.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    small = df.join(large, same, "left_anti").select(*df.columns, F.row_number().over(ordered).cast("long").alias(name), F.count(F.lit(1)).over(whole).alias(f"{name}_n"))
    return small.unionByName(_by_buckets(df.join(large, same, "left_semi"), by, bucket, order, name))


def _by_buckets(df: DataFrame, by: list[str], bucket: Column, order: list[Column | str], name: str) -> DataFrame:
    rows = df.withColumn("_bucket", bucket)
    counts = rows.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_count"))
    group = W.partitionBy(*by)
    starts = counts.select(*[F.col(c).alias(f"_g_{c}") for c in by], F.col("_bucket").alias("_b"), F.sum("_count").over(group).alias(f"{name}_n"), (F.sum("_count").over(group.orderBy("_bucket")) - F.col("_count")).alias("_start"))
    same = F.col("_bucket").eqNullSafe(F.col("_b"))
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    inside = F.row_number().over(W.partitionBy(*by, "_bucket").orderBy(*order))
    met = rows.withColumn("_inside", inside).join(starts, same)
    return met.select(*df.columns, (F.col("_start") + F.col("_inside")).cast("long").alias(name), f"{name}_n")


def in_hash_order(df: DataFrame, by: list[str], seed: int, key: str, name: str = "_position") -> DataFrame:
    """with_position in hash order of key; buckets are the hash's first three digits."""
    return with_position(df, by, F.substring(hash_key(seed, key), 1, 3), [hash_key(seed, key), F.col(key)], name)


def first_in_hash_order(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """The first n rows in hash order."""
    return in_hash_order(df, [], seed, key).where(F.col("_position") <= n).select(*df.columns)
