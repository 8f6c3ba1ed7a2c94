"""Filters, labels, imputation and scaling of readings, signals and feature rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .quantiles import exact_quantiles

#: What a reading's missing value is stored as. Fixed value of the format.
SENTINEL = -2147483648
DAY = 86_400_000_000


def clean_bp_readings(df: DataFrame, columns: tuple[str, ...] = ("systolic", "diastolic", "pulse")) -> DataFrame:
    """Rows none of whose columns holds the sentinel; null is kept."""
    return df.where(reduce(lambda a, b: a & b, [F.coalesce(F.col(c) != SENTINEL, F.lit(True)) for c in columns]))


def spike_label(df: DataFrame, systolic: int = 130, diastolic: int = 80) -> DataFrame:
    return df.withColumn("BP_spike", F.when((F.col("systolic") > systolic) | (F.col("diastolic") > diastolic), 1).otherwise(0).cast("long"))


def select_modality(df: DataFrame, data_type: str) -> DataFrame:
    """Rows of one type with a number as value."""
    return df.where(F.col("data_type") == data_type).withColumn("value", F.expr("try_cast(value AS double)")).where("value is not null")


def dedupe_timestamps(df: DataFrame) -> DataFrame:
    return df.groupBy("user_id", "data_type", "t").agg(F.avg("value").alias("value"))


def day(t: Column | str) -> Column:
    return F.floor((F.col(t) if isinstance(t, str) else t) / DAY).cast("long")


def drop_first_day(rows: DataFrame, *sources: DataFrame) -> DataFrame:
    """Rows after the earliest day on which the user occurs in any of the sources (rows included)."""
    times = reduce(DataFrame.unionByName, [s.select("user_id", "t") for s in (rows, *sources)])
    first = times.groupBy("user_id").agg(F.min(day("t")).alias("_first"))
    return rows.join(first, "user_id").where(day("t") > F.col("_first")).drop("_first")


def feature_columns(columns: list[str], drop: tuple[str, ...] = (), tokens: tuple[str, ...] = ()) -> list[str]:
    """Names that are not dropped and hold none of the tokens, in order."""
    return [c for c in columns if c not in drop and not any(t in c for t in tokens)]


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def seq_mean(c: Column | str) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x) / F.size(c)


def seq_std(c: Column | str) -> Column:
    """Population standard deviation of an array."""
    return let(seq_mean(c), lambda m: F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / F.size(c)))


def drop_flatline(df: DataFrame, columns: tuple[str, ...] = ("hr_seq", "st_seq")) -> DataFrame:
    return df.where(F.least(*[seq_std(F.col(c)) for c in columns]) > 1e-12)


def drop_all_zero(df: DataFrame, column: str = "hr_seq") -> DataFrame:
    return df.where(F.exists(column, lambda x: x != 0))


def impute_features(train: DataFrame, df: DataFrame, columns: list[str]) -> DataFrame:
    """Numbers with infinities and gaps replaced by the train median, or 0 where there is none."""
    number = lambda c: F.expr(f"CASE WHEN abs(try_cast(`{c}` AS double)) < double('infinity') THEN try_cast(`{c}` AS double) END")
    medians = exact_quantiles(train, {c: (number(c), [0.5]) for c in columns})
    return df.select(*[x for x in df.columns if x not in columns], *[F.coalesce(number(c), F.lit(medians[c][0]), F.lit(0.0)).alias(c) for c in columns])


def scale_features(train: DataFrame, df: DataFrame, columns: list[str]) -> DataFrame:
    """z-scores by train mean and population deviation; a constant column becomes 0."""
    stats = train.select(*[F.avg(c).alias(f"_a_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    met = df.crossJoin(F.broadcast(stats))  # one row
    z = lambda c: (F.col(c) - F.col(f"_a_{c}")) / F.when(F.col(f"_s_{c}") > 1e-12, F.col(f"_s_{c}")).otherwise(1.0)
    return met.select(*[x for x in df.columns if x not in columns], *[z(c).alias(c) for c in columns])


def complete_users(signals: DataFrame, readings: DataFrame) -> DataFrame:
    """Users with hr, steps and readings."""
    kinds = signals.where(F.col("data_type").isin("hr", "steps")).select("user_id", "data_type").union(readings.select("user_id", F.lit("readings")))
    return kinds.groupBy("user_id").agg(F.countDistinct("data_type").alias("n")).where("n = 3").select("user_id")


def small_split_report(df: DataFrame, min_total: int = 20, min_per_class: int = 5) -> DataFrame:
    """(user_id, split) with fewer rows than wanted in all or in a class."""
    counts = df.groupBy("user_id", "split").agg(F.count(F.lit(1)).alias("total"), F.sum(F.col("state_val")).alias("pos"))
    return counts.withColumn("neg", F.col("total") - F.col("pos")).where((F.col("total") < min_total) | (F.least("pos", "neg") < min_per_class))


def time_cutoff_split(df: DataFrame, days: int = 20) -> DataFrame:
    first = F.min("t").over(W.partitionBy("user_id"))
    return df.withColumn("split", F.when(F.col("t") < first + days * DAY, "train").otherwise("test"))


def chronological_day_split(df: DataFrame, frac: float = 0.75) -> DataFrame:
    """The first int(days * frac) distinct days of each user are train days."""
    days = df.select("user_id", day("t").alias("_day")).distinct()
    w = W.partitionBy("user_id")
    days = days.withColumn("_rank", F.row_number().over(w.orderBy("_day"))).withColumn("_n", F.count(F.lit(1)).over(w))
    days = days.select("user_id", "_day", F.when(F.col("_rank") <= F.floor(F.col("_n") * frac), "train").otherwise("test").alias("split"))
    return df.withColumn("_day", day("t")).join(days, ["user_id", "_day"]).drop("_day")


def hide_labels(df: DataFrame) -> DataFrame:
    return df.withColumn("true_label", F.col("state_val")).withColumn("state_val", F.lit(-1).cast("long"))


def cohort_filter(df: DataFrame, cohort: DataFrame, substance: str, scenario: str) -> DataFrame:
    allowed = cohort.where((F.col("substance") == substance) & (F.col("scenario") == scenario)).select("user_id").distinct()
    return df.join(allowed, "user_id", "left_semi")


def filter_self_reports(df: DataFrame, substance: str, scenario: str) -> DataFrame:
    """Reports of a scenario; of the substance too, unless the scenario is None."""
    keep = F.col("scenario") == scenario
    return df.where(keep if scenario == "None" else keep & (F.col("substance") == substance))
