"""Fixed-length labelled windows, sliding windows and their bins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import zscore_seq
from ..hashing import with_position
from .clean import DAY
from .quantiles import exact_quantiles
from .temporal import HOUR, MINUTE, asof_backward, bounds


def label_windows(labels: DataFrame, signals: DataFrame, key: str = "reading_id", half: int = HOUR, bin_size: int = 4 * MINUTE, n: int = 30) -> DataFrame:
    """labels with hr_seq and st_seq, each n z-scored bin means around the label's time; labels without both are left out.

    Only the grid points within half of a label are made, each once. A signal needs n grid minutes and n bins; bins are aligned to
    midnight and the first n count.
    """
    at = bounds(signals)
    first = F.greatest(F.ceil((F.col("t") - half - F.col("mn")) / MINUTE).cast("long"), F.lit(0).cast("long"))
    last = F.floor((F.least(F.col("t") + half, F.col("mx")) - F.col("mn")) / MINUTE).cast("long")
    near = labels.select(key, "user_id", "t").join(at, "user_id").withColumn("_k0", first).withColumn("_k1", last).where("_k1 - _k0 + 1 >= " + str(n))
    # labels of one user share grid points: each is looked up once, however many labels are near
    probes = near.select("user_id", "data_type", "mn", "_k0", "_k1").distinct().select("user_id", "data_type", "mn", F.explode(F.sequence("_k0", "_k1")).alias("_k"))
    probes = probes.select("user_id", "data_type", (F.col("mn") + F.col("_k") * MINUTE).alias("t")).distinct()
    spots = near.select("user_id", "data_type", F.explode(F.sequence(F.floor((F.col("mn") + F.col("_k0") * MINUTE) / DAY), F.floor((F.col("mn") + F.col("_k1") * MINUTE) / DAY))).alias("_bucket"))  # one day or two a label
    values = asof_backward(probes, signals, ["user_id", "data_type"], {"value": "value"}, spots=spots)
    of_bin = lambda t: F.floor(t / bin_size).cast("long")
    # a bin's grid points
    points = values.where("value is not null").groupBy("user_id", "data_type", of_bin(F.col("t")).alias("bin")).agg(F.array_sort(F.collect_list(F.struct("t", F.col("value").cast("double").alias("value")))).alias("_points"))
    start, end = F.col("mn") + F.col("_k0") * MINUTE, F.col("mn") + F.col("_k1") * MINUTE
    asked = near.select(key, "user_id", "data_type", start.alias("_start"), end.alias("_end"), F.explode(F.sequence(of_bin(start), of_bin(end))).alias("bin"))
    met = asked.join(points, ["user_id", "data_type", "bin"]).withColumn("_in", F.filter("_points", lambda x: (x["t"] >= F.col("_start")) & (x["t"] <= F.col("_end"))))
    met = met.select(key, "data_type", "bin", F.aggregate("_in", F.lit(0.0), lambda s, x: s + x["value"]).alias("_sum"), F.size("_in").alias("_n")).where("_n > 0")
    bins = met.groupBy(key, "data_type", "bin").agg((F.sum("_sum") / F.sum("_n")).alias("v"))
    # 31 bins at most
    both = bins.where("v is not null").groupBy(key).agg(
        F.slice(F.transform(F.array_sort(F.collect_list(F.when(F.col("data_type") == "hr", F.struct("bin", "v")))), lambda x: x["v"]), 1, n).alias("hr_raw"),
        F.slice(F.transform(F.array_sort(F.collect_list(F.when(F.col("data_type") == "steps", F.struct("bin", "v")))), lambda x: x["v"]), 1, n).alias("st_raw"),
    )
    whole = both.where((F.size("hr_raw") == n) & (F.size("st_raw") == n))
    return labels.join(whole.select(key, zscore_seq(F.col("hr_raw")).alias("hr_seq"), zscore_seq(F.col("st_raw")).alias("st_seq")), key)


def sliding_windows(df: DataFrame, size: int = 30, step: int = 15, train_days: DataFrame | None = None) -> DataFrame:
    """user_id, window_id, seq: full windows of `size` samples, every `step`, over each user's z-scored values in time order.

    With train_days (user_id, day), windows and z-scores are of the samples of those days alone.
    """
    if train_days is not None:
        days = train_days.select("user_id", F.col("day").alias("_day"))
        df = df.withColumn("_day", F.floor(F.col("t") / DAY)).join(days, ["user_id", "_day"], "left_semi").drop("_day")
    stats = df.groupBy("user_id").agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    ranked = with_position(df.select("user_id", "t", "value"), ["user_id"], F.floor(F.col("t") / DAY), ["t"], "_i").join(stats, "user_id")
    z = (F.col("value") - F.col("_m")) / F.when(F.col("_s") > 1e-12, F.col("_s")).otherwise(1.0)
    rows = ranked.select("user_id", "t", z.alias("z"), (F.col("_i") - 1).alias("i"))
    top = F.floor(F.col("i") / step).cast("long")
    ids = F.sequence(F.greatest(top - (size // step - 1), F.lit(0).cast("long")), top)
    spread = rows.select("user_id", "i", "z", F.explode(ids).alias("window_id")).where(F.col("i") < F.col("window_id") * step + size)
    out = spread.groupBy("user_id", "window_id").agg(F.array_sort(F.collect_list(F.struct("i", "z"))).alias("_s"))  # `size` at most
    return out.where(F.size("_s") == size).select("user_id", "window_id", F.transform("_s", lambda x: x["z"]).alias("seq"))


def variance_bins(df: DataFrame, score: str, q: int = 10) -> DataFrame:
    """df with bin: how many inner quantile edges, doubles dropped, lie below the score."""
    edges = exact_quantiles(df, {"edges": (F.col(score), [i / q for i in range(1, q)])})["edges"]
    inner = sorted({e for e in edges if e is not None})
    return df.withColumn("bin", sum(((F.col(score) > e).cast("long") for e in inner), F.lit(0).cast("long")))
