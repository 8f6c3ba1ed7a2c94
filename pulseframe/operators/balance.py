"""Balancing classes: dropping negatives, adding copies of positives, by turns over users and under caps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..hashing import hash_normal, in_hash_order, with_position


def undersample_negatives(df: DataFrame, seed: int, key: str, label: str = "state_val") -> DataFrame:
    """df without negatives in excess of the positives, dropped one of each user in turn.

    The k-th negative of a user in hash order goes in turn k; users within a turn go by id.
    """
    negatives = df.where(F.col(label) == 0)
    many = max(0, negatives.count() - df.where(F.col(label) == 1).count())
    own = in_hash_order(negatives, ["user_id"], seed, key, "_turn")
    gone = with_position(own, [], F.col("_turn"), ["user_id"]).where(F.col("_position") <= many)
    return df.join(gone.select(key), key, "left_anti")


def turns(quota: DataFrame, want: int, cap: str | None = None) -> DataFrame:
    """user_id, extra: `want` handed out one at a time over users by id, each up to its column `cap`.

    Closed form: the water level is the largest number of whole rounds that fit; the rest goes to the first users that
    still have room. quota: a row for each user.
    """
    if cap is None:
        n = quota.count()
        each, rest = (want // n, want % n) if n else (0, 0)
        rank = F.row_number().over(W.partitionBy(F.lit(0)).orderBy("user_id"))  # a row for each user
        return quota.withColumn("_r", rank).select("user_id", (F.lit(each) + F.when(F.col("_r") <= rest, 1).otherwise(0)).cast("long").alias("extra"))
    # level l serves sum(min(cap, l)); caps in order give the level between two of them
    everyone = W.partitionBy(F.lit(0))  # a row for each user
    byc = everyone.orderBy(cap, "user_id")
    q = quota.withColumn("_below", F.coalesce(F.sum(cap).over(byc.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("_left", F.count(F.lit(1)).over(everyone) - F.row_number().over(byc) + 1)
    q = q.withColumn("_level", F.floor((want - F.col("_below")) / F.col("_left")))
    level = F.min(F.when(F.col("_level") < F.col(cap), F.struct("_below", "_left", "_level"))).over(everyone)
    q = q.withColumn("_l", level).withColumn("_full", F.col("_l").isNull())
    base = F.when(F.col("_full"), F.col(cap)).otherwise(F.least(F.col(cap), F.col("_l._level")))
    q = q.withColumn("_base", base).withColumn("_rest", F.when(F.col("_full"), 0).otherwise(F.lit(want) - F.sum("_base").over(everyone)))
    room = F.col("_base") < F.col(cap)
    q = q.withColumn("_room", room).withColumn("_turn", F.sum(F.col("_room").cast("int")).over(everyone.orderBy("user_id")))
    return q.select("user_id", (F.col("_base") + F.when(F.col("_room") & (F.col("_turn") <= F.col("_rest")), 1).otherwise(0)).cast("long").alias("extra"))


def add_copies(df: DataFrame, source: DataFrame, quota: DataFrame, seed: int, key: str, seqs: tuple[str, ...] = (), sigma: float = 0.05) -> DataFrame:
    """df with copy 0 and `extra` copies of each user's source rows, in hash order again and again.

    Sequences of copies get noise of sigma times their sample deviation.
    """
    ranked = in_hash_order(source, ["user_id"], seed, key, "_r").withColumn("_r", F.col("_r") - 1).withColumnRenamed("_r_n", "_n").join(quota, "user_id")
    times = F.floor((F.col("extra") - F.col("_r") + F.col("_n") - 1) / F.col("_n")).cast("int")
    more = ranked.withColumn("copy", F.explode(F.filter(F.sequence(F.lit(0), times), lambda x: x > 0))).drop("_r", "_n", "extra")
    for s in seqs:
        from .clean import let, seq_std

        dev = let(seq_std(F.col(s)) * F.sqrt(F.size(s) / F.greatest(F.size(s) - 1, F.lit(1))), lambda x: x)
        more = more.withColumn("_dev", dev).withColumn(s, F.transform(s, lambda x, i: x + sigma * F.col("_dev") * hash_normal(seed, key, "copy", i))).drop("_dev")
    return df.withColumn("copy", F.lit(0)).unionByName(more)


def oversample_positives(df: DataFrame, seed: int, key: str, label: str = "state_val", seqs: tuple[str, ...] = ()) -> DataFrame:
    """Jittered copies of positives until both classes are equal, one of each user with positives in turn."""
    pos, neg = df.where(F.col(label) == 1), df.where(F.col(label) == 0).count()
    quota = turns(pos.select("user_id").distinct(), max(0, neg - pos.count()))
    return add_copies(df, pos, quota, seed, key, seqs)


def oversample_minority_capped(df: DataFrame, seed: int, key: str, label: str = "state_val", ratio: float = 1.0, cap: int = 10) -> DataFrame:
    """Copies of the minority up to ceil(ratio * majority), in turns over users, none above cap times its own rows."""
    sizes = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}  # a row for each class
    if len(sizes) < 2:
        return df.withColumn("copy", F.lit(0))
    minority = min(sizes, key=lambda c: (sizes[c], -c))
    want = max(0, -int(-(ratio * max(sizes.values())) // 1) - sizes[minority])
    few = df.where(F.col(label) == minority)
    quota = turns(few.groupBy("user_id").agg((F.count(F.lit(1)) * (cap - 1)).alias("most")), want, "most")
    return add_copies(df, few, quota, seed, key)


def slice_plan(df: DataFrame, budget: int = 30, ratio: float = 0.43, label: str = "state_val") -> DataFrame:
    """label, extra: further slices a row of each class: max(0, round(budget * share / n) - 1), halves to even; 0 with one row."""
    share = F.when(F.col(label) == 1, F.lit(ratio)).otherwise(F.lit(1 - ratio))
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(label, F.when(F.col("n") > 1, F.greatest(F.bround(budget * share / F.col("n")) - 1, F.lit(0))).otherwise(0).cast("long").alias("extra"))
