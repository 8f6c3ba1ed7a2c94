"""Day splits and row samplers in hash order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..hashing import first_in_hash_order, hash_key, in_hash_order, with_position


def labeled_day_splits(labeled: DataFrame, day_split: DataFrame) -> DataFrame:
    """Train days cut down to those with labelled rows; the others as they are."""
    from .clean import day

    held = labeled.select("user_id", day("t").alias("day")).distinct()
    return day_split.where("split = 'train'").join(held, ["user_id", "day"], "left_semi").unionByName(day_split.where("split <> 'train'"))


# fixed values: test sizes in the order in which they are tried
TEST_SIZES = (0.2, 0.18, 0.22, 0.16, 0.24, 0.15, 0.25, 0.17, 0.19, 0.21)


def day_split_retry(days: DataFrame, seed: int = 42, sizes: tuple[float, ...] = TEST_SIZES) -> DataFrame:
    """user_id, day, split from days (user_id, day, n, pos): the first size whose test days hold enough of both classes.

    Days are drawn in one hash order, so that test sets of all sizes are prefixes of it. Validation days are a quarter
    of the rest, rounded up, with a proportional share of the days of each window count (largest remainders, ties to
    smaller counts) where each count occurs on two days or more and both sides have a day for each; else the next days
    in order. A size is accepted with at least 2 test windows, 2 positives, 2 negatives and 2 validation windows. Users
    that no size fits are left out: see skipped_users.
    """
    user = W.partitionBy("user_id")
    ranked = days.withColumn("_rank", F.row_number().over(user.orderBy(hash_key(seed, "user_id", "day"), "day"))).withColumn("_days", F.count(F.lit(1)).over(user))
    tries = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(s).alias("s")) for i, s in enumerate(sizes)])
    each = ranked.withColumn("_try", F.explode(tries)).withColumn("_i", F.col("_try.i")).withColumn("_test", F.ceil(F.round(F.col("_try.s") * F.col("_days"), 9)))
    each = each.withColumn("_rest", F.col("_days") - F.col("_test")).withColumn("_val", F.ceil(0.25 * F.col("_rest"))).withColumn("_in", F.col("_rank") > F.col("_test"))
    # a user's days of one window count are a class; all windows are over a user's days of one size
    whole, kind = W.partitionBy("user_id", "_i", "_in"), W.partitionBy("user_id", "_i", "_in", "n")
    each = each.withColumn("_size", F.count(F.lit(1)).over(kind)).withColumn("_place", F.row_number().over(kind.orderBy("_rank")))
    share, first = F.col("_val") * F.col("_size"), F.col("_place") == 1
    each = each.withColumn("_floor", F.floor(share / F.greatest("_rest", F.lit(1)))).withColumn("_left", F.pmod(share, F.greatest("_rest", F.lit(1)))).withColumn("_first", first.cast("int"))
    each = each.withColumn("_order", F.row_number().over(whole.orderBy(F.desc("_first"), F.desc("_left"), "n")))
    each = each.withColumn("_turn", F.min("_order").over(kind))
    classes, extra = F.sum("_first").over(whole), F.col("_val") - F.sum(F.col("_first") * F.col("_floor")).over(whole)
    possible = (F.min("_size").over(whole) >= 2) & (F.col("_val") >= classes) & (F.col("_rest") - F.col("_val") >= classes)
    each = each.withColumn("_possible", possible).withColumn("_quota", F.col("_floor") + (F.col("_turn") <= extra).cast("int"))
    val = F.when(F.col("_possible"), F.col("_place") <= F.col("_quota")).otherwise(F.col("_rank") <= F.col("_test") + F.col("_val"))
    each = each.withColumn("split", F.when(~F.col("_in"), "test").when(val, "val").otherwise("train"))
    sums = each.groupBy("user_id", "_i").agg(
        F.sum(F.when(F.col("split") == "test", F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("split") == "test", F.col("pos")).otherwise(0)).alias("p"),
        F.sum(F.when(F.col("split") == "val", F.col("n")).otherwise(0)).alias("v"),
    )
    fits = sums.where("t >= 2 AND p >= 2 AND t - p >= 2 AND v >= 2").groupBy("user_id").agg(F.min("_i").alias("_i"))
    return each.join(fits, ["user_id", "_i"]).select("user_id", "day", "split")


def skipped_users(days: DataFrame, split: DataFrame) -> DataFrame:
    """user_id, days, windows, positives, reason of the users whom day_split_retry leaves out."""
    sums = days.groupBy("user_id").agg(F.count(F.lit(1)).alias("days"), F.sum("n").alias("windows"), F.sum("pos").alias("positives"))
    few = F.least("positives", F.col("windows") - F.col("positives")) < 2
    reason = F.when(F.col("windows") < 4, "too few windows").when(few, "too few of a class").otherwise("no size fits")
    return sums.join(split.select("user_id").distinct(), "user_id", "left_anti").withColumn("reason", reason)


def sample_count_day_split(days: DataFrame, frac: float = 0.25, seed: int = 42) -> DataFrame:
    """user_id, day, split: days in hash order go to test until they hold frac of the user's rows. days: user_id, day, n."""
    user = W.partitionBy("user_id")
    order = user.orderBy(hash_key(seed, "user_id", "day"), "day")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rank, count = F.row_number().over(order), F.count(F.lit(1)).over(user)
    total = F.sum("n").over(user)
    by_days = F.when(rank <= F.bround(count * 0.75), "train").otherwise("test")
    return days.select("user_id", "day", F.when(total == 0, by_days).when(before < frac * total, "test").otherwise("train").alias("split"))


def apportioned(sizes: DataFrame, frac: float, by: list[str], within: list[str] = ()) -> DataFrame:
    """sizes (by, n) with quota: shares of round(frac * total) (halves up) by largest remainders, ties in the order of `by`.

    Totals are taken inside equal `within`, which is part of `by`; without it, over all strata.
    """
    within = list(within)
    share = F.round(frac * F.col("n"), 9)
    rows = sizes.withColumn("_floor", F.floor(share).cast("long")).withColumn("_left", F.round(share - F.floor(share), 9))
    ranked = with_position(rows, within, F.floor(-1000 * F.col("_left")), [F.desc("_left"), *by], "_turn")
    totals = rows.groupBy(*within).agg((F.floor(F.round(frac * F.sum("n"), 9) + 0.5) - F.sum("_floor")).alias("_extra"))
    met = ranked.join(totals, within) if within else ranked.crossJoin(F.broadcast(totals))  # one row
    return met.select(*by, "n", (F.col("_floor") + (F.col("_turn") <= F.col("_extra")).cast("long")).alias("quota"))


def stratified_split(df: DataFrame, frac: float, by: list[str], seed: int, key: str, within: list[str] = ()) -> DataFrame:
    """df with chosen: round(frac * n) rows in all (or inside equal `within`), each stratum's by largest remainders, in hash order."""
    ranked = in_hash_order(df, by, seed, key)
    names = [f"_s{i}" for i in range(len(by))]
    quotas = apportioned(df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")), frac, by, within).select(*[F.col(c).alias(n) for c, n in zip(by, names, strict=True)], "quota")
    same = F.lit(True)
    for c, n in zip(by, names, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(n))
    met = ranked.join(quotas, same) if by else ranked.crossJoin(F.broadcast(quotas))  # one row
    return met.select(*df.columns, (F.col("_position") <= F.col("quota")).alias("chosen"))


def safe_sample(df: DataFrame, frac: float, label: str, seed: int, key: str) -> DataFrame:
    """A stratified sample; plain if a class is missing or has one row; everything if frac >= 1."""
    if frac >= 1:
        return df
    sizes = [r["count"] for r in df.groupBy(label).count().collect()]  # a row for each class
    by = [label] if len(sizes) >= 2 and min(sizes) >= 2 else []
    return stratified_split(df, frac, by, seed, key).where("chosen").drop("chosen")


def stratified_split_min(df: DataFrame, frac: float, label: str, seed: int, key: str, least: int = 5) -> DataFrame:
    """df with hidden: of each class, clip(int(n * frac), 0, n - least) rows are hidden, in hash order."""
    ranked, n = in_hash_order(df, [label], seed, key), F.col("_position_n")
    many = F.greatest(F.lit(0), F.least(F.floor(n * frac), n - least))
    return ranked.select(*df.columns, (F.col("_position") <= many).alias("hidden"))


def min_per_user_split(df: DataFrame, frac: float, seed: int, key: str, least: int = 2) -> DataFrame:
    """The rows labelled first: `least` of each user, then one of each user in turn until ceil(frac * N)."""
    own = in_hash_order(df, ["user_id"], seed, key, "_own")
    turn = F.greatest(F.col("_own") - least, F.lit(0))
    ranked = with_position(own.withColumn("_turn", turn), [], F.col("_turn"), [hash_key(seed, "user_id"), F.col("user_id"), F.col("_own")])
    return ranked.where((F.col("_turn") == 0) | (F.col("_position") <= F.ceil(frac * F.col("_position_n")))).select(*df.columns)


def target_quota_split(df: DataFrame, target: int, uf: float, seed: int, key: str, label: str = "state_val") -> DataFrame:
    """max(4, round((1 - uf) * N)) labelled rows: one of each class of the target user, the rest of the others by class share, at least one of each."""
    want = max(4, round((1 - uf) * df.count()))
    own = in_hash_order(df.where(F.col("user_id") == target), [label], seed, key).where("_position = 1").select(*df.columns)
    others = df.where(F.col("user_id") != target)
    sizes = {r[label]: r["count"] for r in others.groupBy(label).count().collect()}  # a row for each class
    total, left = sum(sizes.values()), max(0, want - own.count())
    quota = F.coalesce(*[F.when(F.col(label) == c, F.lit(max(1, round(left * m / total)))) for c, m in sizes.items()], F.lit(0)) if sizes else F.lit(0)
    more = in_hash_order(others, [label], seed, key, "_rank").where(F.col("_rank") <= quota)
    # beyond the number wanted, later turns of the classes go first
    more = with_position(more, [], F.col("_rank"), [hash_key(seed, key), F.col(key)]).where(F.col("_position") <= left)
    return own.unionByName(more.select(*df.columns))


def staged_fill(df: DataFrame, first: DataFrame, want: int, seed: int, key: str) -> DataFrame:
    """first, and then rows of df in hash order up to `want` rows."""
    rest = df.join(first.select(key), key, "left_anti")
    return first.unionByName(first_in_hash_order(rest, max(0, want - first.count()), seed, key))


def day_class_seed(df: DataFrame, uf: float, seed: int, key: str, label: str = "state_val", by: tuple[str, ...] = ("day",)) -> DataFrame:
    """max(1, int((1 - uf) * N)) rows: one of each day, half of the remainder positive, the rest of it negative, filled at random.

    More days than rows wanted are an error.
    """
    want = max(1, int((1 - uf) * df.count()))
    days = in_hash_order(df, list(by), seed, key).where("_position = 1").select(*df.columns)
    n_days = days.count()
    if n_days > want:
        raise ValueError(f"{n_days} days do not fit into {want} rows")
    pos = (want - n_days) // 2
    ranked = in_hash_order(df.join(days.select(key), key, "left_anti"), [label], seed, key)
    more = ranked.where(((F.col(label) == 1) & (F.col("_position") <= pos)) | ((F.col(label) == 0) & (F.col("_position") <= want - n_days - pos)))
    return staged_fill(df, days.unionByName(more.select(*df.columns)), want, seed, key)


def variance_seed(df: DataFrame, score: str, uf: float, seed: int, key: str, q: int = 10) -> DataFrame:
    """int((1 - uf) * N) rows: one of each variance bin, filled at random. More bins than rows wanted are an error."""
    from .windows import variance_bins

    want = int((1 - uf) * df.count())
    one = in_hash_order(variance_bins(df, score, q), ["bin"], seed, key).where("_position = 1").select(*df.columns)
    if (bins := one.count()) > want:
        raise ValueError(f"{bins} bins do not fit into {want} rows")
    return staged_fill(df, one, want, seed, key)


def representative_seed(df: DataFrame, uf: float, key: str, vector: str, method: str = "kmeans", seed: int = 42) -> DataFrame:
    """max(1, int((1 - uf) * N)) rows: the nearest to as many k-means centres, or k-centre picks, filled at random."""
    from .vectors import kcenter_seed, kmeans_query

    want = max(1, int((1 - uf) * df.count()))
    if method == "kmeans":
        ids = kmeans_query(df.limit(0), df, want, key, vector)
    elif method == "kcenter":
        ids = kcenter_seed(df, want, key, vector)
    else:
        raise ValueError("method must be 'kmeans' or 'kcenter'")
    return staged_fill(df, df.join(ids.select(key), key, "left_semi"), want, seed, key)


def day_balanced_seed(df: DataFrame, seed: int, key: str, label: str = "state_val") -> DataFrame:
    """key of one row a day of each user, in day order, of the class behind so far (positive on a tie) if the day has it."""
    best = lambda v: F.min_by(F.when(F.col(label) == v, F.col(key)), F.when(F.col(label) == v, hash_key(seed, key)))
    days = df.groupBy("user_id", "day").agg(best(1).alias("p"), best(0).alias("n"))
    one_user = F.array_sort(F.collect_list(F.struct("day", "p", "n")))  # a user's days

    def step(s, x):
        wants_pos = s["pos"] <= s["neg"]
        takes_pos = x["p"].isNotNull() & (wants_pos | x["n"].isNull())
        return F.struct((s["pos"] + takes_pos.cast("int")).alias("pos"), (s["neg"] + (~takes_pos).cast("int")).alias("neg"), F.concat(s["keys"], F.array(F.when(takes_pos, x["p"]).otherwise(x["n"]))).alias("keys"))

    start = F.struct(F.lit(0).alias("pos"), F.lit(0).alias("neg"), F.array().cast(f"array<{dict(df.dtypes)[key]}>").alias("keys"))
    return days.groupBy("user_id").agg(F.aggregate(one_user, start, step)["keys"].alias("_k")).select("user_id", F.explode("_k").alias(key))


def split_rows_80_20(df: DataFrame, seed: int, key: str) -> DataFrame:
    """df with split: the first int(0.8 * n) rows of each user in hash order train, the others val."""
    ranked = in_hash_order(df, ["user_id"], seed, key)
    return ranked.select(*df.columns, F.when(F.col("_position") <= F.floor(0.8 * F.col("_position_n")), "train").otherwise("val").alias("split"))


def date_overlap(train: DataFrame, test: DataFrame) -> DataFrame:
    """(user_id, day) in both; must be empty."""
    return train.select("user_id", "day").intersect(test.select("user_id", "day"))
