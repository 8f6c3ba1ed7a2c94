"""As-of and interval joins, minute grids, rolling features, lags and fills. Times are microseconds in `t`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..hashing import hash_key
from .clean import DAY

MINUTE = 60_000_000
HOUR = 60 * MINUTE


def asof_backward(left: DataFrame, right: DataFrame, by: list[str], values: dict[str, str], on: str = "t", bucket: int = DAY, spots: DataFrame | None = None) -> DataFrame:
    """left with, for each name: column of `values`, the column of the latest right row not after left's time; null if none.

    Work is dealt by (by, bucket of time), so that one long series is many tasks: within a bucket the last right row is
    carried over the union of both sides, and each bucket starts from the last right row of the buckets before it.
    spots (by, _bucket) may name the left's buckets, and more, where they are cheaper to have than from left.
    """
    keys = [*by, "_bucket"]
    cut = F.floor(F.col(on) / bucket).cast("long")
    picked = F.struct(*[F.col(c).alias(n) for n, c in values.items()])
    r = right.select(*by, F.col(on), cut.alias("_bucket"), picked.alias("_right")).where(F.col(on).isNotNull())
    held = F.struct(*[F.col(c) for c in left.columns])
    both = left.select(*by, F.col(on), cut.alias("_bucket"), held.alias("_left"), F.lit(None).cast(r.schema["_right"].dataType).alias("_right"), F.lit(1).alias("_side"))
    both = both.unionByName(r.select(*by, F.col(on), "_bucket", "_right", F.lit(0).alias("_side")), allowMissingColumns=True)
    inside = W.partitionBy(*keys).orderBy(on, "_side").rowsBetween(W.unboundedPreceding, 0)
    met = both.withColumn("_found", F.last("_right", ignorenulls=True).over(inside)).where("_side = 1")
    ends = r.groupBy(*keys).agg(F.max_by("_right", on).alias("_end"))
    starts = (left.select(*by, cut.alias("_bucket")) if spots is None else spots.select(*keys)).distinct().join(ends, keys, "full")
    earlier = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = starts.withColumn("_carried", F.last("_end", ignorenulls=True).over(earlier)).select(*keys, "_carried")
    met = met.join(starts, keys, "left").withColumn("_got", F.coalesce("_found", "_carried"))
    return met.select("_left.*", *[F.col(f"_got.{n}").alias(n) for n in values])


def bounds(signals: DataFrame) -> DataFrame:
    return signals.groupBy("user_id", "data_type").agg(F.min("t").alias("mn"), F.max("t").alias("mx"))


def minute_grid(signals: DataFrame) -> DataFrame:
    """user_id, data_type, t: a point a minute from the first to the last sample, with the first sample's seconds."""
    return bounds(signals).select("user_id", "data_type", F.explode(F.sequence("mn", "mx", F.lit(MINUTE))).alias("t"))


def minute_grid_ffill(signals: DataFrame) -> DataFrame:
    """The grid with the latest value at each point."""
    return asof_backward(minute_grid(signals), signals, ["user_id", "data_type"], {"value": "value"})


def round_minute(t: Column) -> Column:
    """Number of the nearest minute, halves to even."""
    q, r = F.floor(t / MINUTE).cast("long"), F.pmod(t, F.lit(MINUTE))
    up = (r > MINUTE // 2) | ((r == MINUTE // 2) & (q % 2 == 1))
    return q + F.when(up, 1).otherwise(0)


def interval_join_agg(rows: DataFrame, other: DataFrame, key: str, value: str, half: int = 15 * MINUTE) -> DataFrame:
    """rows with mean, min, max and sample deviation of other's value within the closed +-half of the row's time, by user.

    Equi-join on (user, bucket) over the one or two buckets that the interval touches, then the exact test.
    """
    width = 2 * half
    spot = lambda t: F.floor(t / width).cast("long")
    near = rows.select(key, "user_id", F.col("t").alias("_t"), F.explode(F.array_distinct(F.array(spot(F.col("t") - half), spot(F.col("t") + half)))).alias("_b"))
    o = other.select("user_id", F.col("t").alias("_o"), F.col(value).cast("double").alias("_v"), spot(F.col("t")).alias("_b"))
    hit = near.join(o, ["user_id", "_b"]).where(F.abs(F.col("_o") - F.col("_t")) <= half)
    stats = hit.groupBy(key).agg(F.avg("_v").alias(f"{value}_mean"), F.min("_v").alias(f"{value}_min"), F.max("_v").alias(f"{value}_max"), F.stddev_samp("_v").alias(f"{value}_std"))
    return rows.join(stats, key, "left")


#: Minutes of a day; digits of the hash by which minutes are counted.
DAY_MINUTES, PREFIX = 1440, 3


def negative_gaps(signals: DataFrame, events: DataFrame, half: int = HOUR) -> DataFrame:
    """user_id, day, first, last, step: runs of hr's grid minutes with no event within the closed +-half.

    A sweep over each user's day: the intervals around its events, in order, and what they leave free between the
    furthest end so far and the next start. Intervals that cross midnight count on both days; equal ones once, so a day
    has no more than its minutes. step is 2 where the grid lies on half minutes, which round to even ones.
    """
    hr = signals.where(F.col("data_type") == "hr").groupBy("user_id").agg(F.min("t").alias("mn"), F.max("t").alias("mx"))
    ends = hr.select("user_id", round_minute(F.col("mn")).alias("_a"), round_minute(F.col("mx") - F.pmod(F.col("mx") - F.col("mn"), F.lit(MINUTE))).alias("_b"), F.when(F.pmod("mn", F.lit(MINUTE)) == MINUTE // 2, 2).otherwise(1).alias("step"))
    over = lambda df, a, b: df.withColumn("day", F.explode(F.sequence(F.floor(F.col(a) / DAY_MINUTES), F.floor(F.col(b) / DAY_MINUTES))))
    from_, to = (lambda a: F.greatest(F.col(a), F.col("day") * DAY_MINUTES)), (lambda b: F.least(F.col(b), (F.col("day") + 1) * DAY_MINUTES - 1))
    days = over(ends, "_a", "_b").select("user_id", "day", from_("_a").alias("lo"), to("_b").alias("hi"), "step")
    near = events.select("user_id", F.ceil((F.col("t") - half) / MINUTE).cast("long").alias("_a"), F.floor((F.col("t") + half) / MINUTE).cast("long").alias("_b")).where("_a <= _b")
    near = over(near, "_a", "_b").select("user_id", "day", from_("_a").alias("a"), to("_b").alias("b")).distinct()
    marks = days.join(near, ["user_id", "day"]).unionByName(days.withColumn("a", F.col("hi") + 1).withColumn("b", F.col("hi") + 1))  # and the day's end
    before = W.partitionBy("user_id", "day").orderBy("a", "b").rowsBetween(W.unboundedPreceding, -1)
    first, last = F.greatest("lo", F.coalesce(F.max("b").over(before), F.col("lo") - 1) + 1), F.least(F.col("a") - 1, "hi")
    free = marks.select("user_id", "day", first.alias("first"), last.alias("last"), "step")
    return free.withColumn("first", F.col("first") + F.pmod("first", "step")).withColumn("last", F.col("last") - F.pmod("last", "step")).where("first <= last")


def minutes_of(gaps: DataFrame) -> DataFrame:
    """user_id, minute: the minutes of the runs, made where the runs are."""
    return gaps.select("user_id", F.explode(F.sequence("first", "last", F.col("step").cast("long"))).alias("minute"))


def negative_candidates(signals: DataFrame, events: DataFrame, half: int = HOUR) -> DataFrame:
    """user_id, minute: grid minutes of hr with no event within the closed +-half."""
    return minutes_of(negative_gaps(signals, events, half))


def sample_minutes(gaps: DataFrame, wanted: DataFrame, seed: int) -> DataFrame:
    """user_id, minute: at most n minutes of each user's runs in hash order; wanted: user_id, n.

    Minutes are counted by user and the first digits of their hashes where they are made; the counts say which digits
    are taken whole and which in part. Then only taken minutes, and the others of one digit group, leave their tasks.
    """
    prefix = F.substring(hash_key(seed, "user_id", "minute"), 1, PREFIX)
    runs = gaps.join(wanted.where("n > 0").select("user_id", F.col("n").alias("_n")), "user_id")
    counts = minutes_of(runs).groupBy("user_id", prefix.alias("_p")).agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(W.partitionBy("user_id").orderBy("_p").rowsBetween(W.unboundedPreceding, -1))  # 16 ** PREFIX rows a user
    cuts = counts.withColumn("_before", F.coalesce(upto, F.lit(0))).join(wanted.select("user_id", F.col("n").alias("_n")), "user_id").where("_before < _n")
    cuts = cuts.groupBy("user_id").agg(F.max(F.struct("_p", "_before", "_n")).alias("_cut"))
    each = runs.join(cuts, "user_id").select("user_id", "_cut", F.explode(F.sequence("first", "last", F.col("step").cast("long"))).alias("minute")).withColumn("_p", prefix).where(F.col("_p") <= F.col("_cut._p"))
    whole = each.where(F.col("_p") < F.col("_cut._p")).select("user_id", "minute")
    rank = F.row_number().over(W.partitionBy("user_id").orderBy(hash_key(seed, "user_id", "minute"), "minute"))
    edge = each.where(F.col("_p") == F.col("_cut._p")).withColumn("_r", rank).where(F.col("_r") <= F.col("_cut._n") - F.col("_cut._before"))
    return whole.unionByName(edge.select("user_id", "minute"))


def top_up_negatives(pos: DataFrame, neg: DataFrame, gaps: DataFrame, seed: int = 42) -> DataFrame:
    """Minutes of the runs that bring each user's negatives up to its positives; none where they are enough."""
    counts = pos.select("user_id", F.lit(1).alias("p"), F.lit(0).alias("q")).union(neg.select("user_id", F.lit(0), F.lit(1))).groupBy("user_id").agg((F.sum("p") - F.sum("q")).alias("n"))
    return sample_minutes(gaps, counts, seed)


def rows_on_days(df: DataFrame, day_split: DataFrame, split: str) -> DataFrame:
    days = day_split.where(F.col("split") == split).select("user_id", F.col("day").alias("_day"))
    return df.withColumn("_day", F.floor(F.col("t") / DAY).cast("long")).join(days, ["user_id", "_day"], "left_semi").drop("_day")


def by_day() -> Column:
    return F.floor(F.col("t") / DAY).cast("long")


def rolling_time_stats(df: DataFrame, minutes: tuple[int, ...] = (5, 10, 30, 60), hr: str = "hr", steps: str = "steps") -> DataFrame:
    """Statistics of both signals over (t - w, t] for each width; one partitioning and order for all frames.

    Dealt by user and day: each day also gets the rows of the widest frame before it, so that a long series is many tasks.
    """
    reach = max(minutes) * MINUTE
    own = by_day()
    spread = df.withColumn("_part", F.explode(F.array_distinct(F.array(own, F.floor((F.col("t") + reach) / DAY).cast("long")))))
    columns = []
    for m in minutes:
        w = W.partitionBy("user_id", "_part").orderBy("t").rangeBetween(-m * MINUTE + 1, 0)
        columns += [f(hr).over(w).alias(f"hr_{n}_{m}min") for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max), ("std", F.stddev_samp))]
        columns += [f(steps).over(w).alias(f"steps_{n}_{m}min") for n, f in (("total", F.sum), ("mean", F.avg), ("min", F.min), ("max", F.max), ("std", F.stddev_samp))]
    rolled = spread.select("*", *columns).where(F.col("_part") == own).drop("_part")
    return rolled.withColumns({f"steps_diff_{m}min": F.col(f"steps_max_{m}min") - F.col(f"steps_min_{m}min") for m in minutes})


def with_rows_before(df: DataFrame, k: int) -> tuple[DataFrame, list[str]]:
    """df with _part (the day) and _own, and the k rows before each user's day once more as its rows with _own false; and the keys of a window.

    A frame that reaches k rows back is then whole inside a day, so that a long series is many tasks. Rows without a
    time are a day of their own, the first.
    """
    rows = df.withColumn("_part", F.coalesce(by_day(), F.lit(-(1 << 62)))).withColumn("_row", F.struct(*df.columns))
    rank = F.row_number().over(W.partitionBy("user_id", "_part").orderBy(F.desc_nulls_last("t")))
    tails = rows.withColumn("_k", rank).where(F.col("_k") <= k).groupBy("user_id", "_part").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_k")).alias("_k"), "_row"))), lambda x: x["_row"]).alias("_tail"))  # k rows
    earlier = W.partitionBy("user_id").orderBy("_part").rowsBetween(-k, -1)
    before = tails.select("user_id", "_part", F.flatten(F.collect_list("_tail").over(earlier)).alias("_rows"))  # each day with rows has one at least
    before = before.select("_part", F.explode(F.slice("_rows", F.greatest(F.size("_rows") - k + 1, F.lit(1)), k)).alias("_row")).select("_row.*", "_part", F.lit(False).alias("_own"))
    return rows.drop("_row").withColumn("_own", F.lit(True)).unionByName(before), ["user_id", "_part"]


def over_rows(df: DataFrame, k: int, columns: Callable[[WindowSpec], list[Column]]) -> DataFrame:
    """df with the columns over a window in the user's time order whose frames reach at most k rows back. df is read twice."""
    rows, keys = with_rows_before(df, k)
    return rows.select("*", *columns(W.partitionBy(*keys).orderBy("t"))).where("_own").drop("_part", "_own")


def rolls(w: WindowSpec, column: str, sizes: tuple[int, ...] = (3, 5)) -> list[Column]:
    out = []
    for n in sizes:
        frame = w.rowsBetween(-n + 1, 0)
        full = F.count(column).over(frame) == n
        out += [F.when(full, f(column).over(frame)).alias(f"{column}_roll{n}_{name}") for name, f in (("mean", F.avg), ("std", F.stddev_samp), ("sum", F.sum))]
    return out


def lagged(w: WindowSpec, columns: list[str], lags: tuple[int, ...] = (1, 3, 5)) -> list[Column]:
    return [F.lag(c, k).over(w).alias(f"{c}_lag_{k}") for c in columns for k in lags]


def gap_minutes(w: WindowSpec) -> Column:
    return ((F.col("t") - F.lag("t").over(w)) / MINUTE).alias("minutes_since_previous")


def rolling_row_stats(df: DataFrame, column: str, sizes: tuple[int, ...] = (3, 5)) -> DataFrame:
    """Mean, deviation and sum over the last 3 and 5 rows; null until the frame is full."""
    return over_rows(df, max(sizes) - 1, lambda w: rolls(w, column, sizes))


def lag_features(df: DataFrame, columns: list[str], lags: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    return over_rows(df, max(lags), lambda w: lagged(w, columns, lags))


def minutes_since_previous(df: DataFrame) -> DataFrame:
    return over_rows(df, 1, lambda w: [gap_minutes(w)])


def ffill_bfill(df: DataFrame, columns: list[str]) -> DataFrame:
    """Gaps filled with the user's last value before, else the next one after.

    Inside a day both ways; a day without a value before (or after) takes it from the days beside it.
    """
    rows = df.withColumn("_part", F.coalesce(by_day(), F.lit(-(1 << 62))))
    day, user = W.partitionBy("user_id", "_part"), W.partitionBy("user_id").orderBy("_part")
    past, ahead = day.orderBy("t").rowsBetween(W.unboundedPreceding, 0), day.orderBy(F.desc("t")).rowsBetween(W.unboundedPreceding, 0)
    valued = lambda c: F.when(F.col(c).isNotNull(), F.struct("t", c))
    ends = rows.groupBy("user_id", "_part").agg(*[x for c in columns for x in (F.max(valued(c))[c].alias(f"_l_{c}"), F.min(valued(c))[c].alias(f"_f_{c}"))])
    before, after = user.rowsBetween(W.unboundedPreceding, -1), W.partitionBy("user_id").orderBy(F.desc("_part")).rowsBetween(W.unboundedPreceding, -1)
    beside = ends.select(F.col("user_id").alias("_u"), F.col("_part").alias("_p"), *[x for c in columns for x in (F.last(f"_l_{c}", True).over(before).alias(f"_b_{c}"), F.last(f"_f_{c}", True).over(after).alias(f"_a_{c}"))])
    filled = rows.select("*", *[x for c in columns for x in (F.last(c, True).over(past).alias(f"_i_{c}"), F.last(c, True).over(ahead).alias(f"_j_{c}"))])
    met = filled.join(beside, F.col("user_id").eqNullSafe(F.col("_u")) & (F.col("_part") == F.col("_p")))
    return met.withColumns({c: F.coalesce(f"_i_{c}", f"_b_{c}", f"_j_{c}", f"_a_{c}") for c in columns}).select(*df.columns)
