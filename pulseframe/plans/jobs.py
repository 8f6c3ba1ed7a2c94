"""End-to-end jobs: windows with day splits, and feature tables for readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import wall_clock
from ..functions.scalars import calendar_features, interaction_features
from ..operators import clean as C
from ..operators import temporal as T
from ..operators import windows as N
from ..sources.paths import written


def build_features(readings: DataFrame, signals: DataFrame, stress: DataFrame, minutes: tuple[int, ...] = (5, 10, 30, 60)) -> DataFrame:
    """A feature row for each reading after its user's first day."""
    hr = C.select_modality(signals, "hr").select("user_id", "t", F.col("value").alias("hr"))
    steps = C.select_modality(signals, "steps")
    rows = C.spike_label(C.drop_first_day(readings, hr))
    rolled = T.rolling_time_stats(T.asof_backward(hr, steps, ["user_id"], {"steps": "value"}), minutes)
    names = [c for c in rolled.columns if c.endswith("min")]
    rows = T.asof_backward(rows, rolled, ["user_id"], {c: c for c in names})
    rows = T.interval_join_agg(rows, stress, "reading_id", "stress")
    lags = ["BP_spike", "stress_mean", "hr_mean_5min", "steps_total_10min"]
    rows = T.over_rows(written(rows, "feature-rows"), 5, lambda w: [*T.lagged(w, lags), *T.rolls(w, "hr_mean_5min"), T.gap_minutes(w)])
    rows = T.ffill_bfill(rows, ["stress_mean", "stress_min", "stress_max", "stress_std", "minutes_since_previous"])
    wide = rows.withColumns({"hr_mean": F.col("hr_mean_60min"), "hr_std": F.col("hr_std_60min"), "steps_total": F.col("steps_total_60min"), "steps_std": F.col("steps_std_60min")})
    wide = wide.withColumns(interaction_features()).drop("hr_mean", "hr_std", "steps_total", "steps_std")
    return wide.withColumns(calendar_features(wall_clock(F.col("t"))))


def build_windows(readings: DataFrame, signals: DataFrame, seed: int = 42) -> DataFrame:
    """Windows around spikes and sampled quiet minutes, each with the split of its day; users without a split are left out."""
    from ..operators.splits import day_split_retry

    users = C.complete_users(signals, readings)
    readings, signals = readings.join(users, "user_id", "left_semi"), signals.join(users, "user_id", "left_semi")
    marked = C.spike_label(readings)
    pos, neg = marked.where("BP_spike = 1"), marked.where("BP_spike = 0")
    more = T.top_up_negatives(pos, neg, T.negative_gaps(signals, pos), seed)
    labels = marked.select("user_id", "t", F.col("BP_spike").alias("state_val"), F.concat(F.lit("r"), F.col("reading_id").cast("string")).alias("label_id"))
    labels = labels.unionByName(more.select("user_id", (F.col("minute") * T.MINUTE).alias("t"), F.lit(0).cast("long").alias("state_val"), F.concat_ws(":", F.lit("n"), F.col("user_id"), F.col("minute")).alias("label_id")))
    made = written(N.label_windows(labels, signals, key="label_id").withColumn("day", C.day("t")), "windows")  # counted, then split
    per_day = made.groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("n"), F.sum("state_val").alias("pos"))
    return made.join(day_split_retry(per_day, seed), ["user_id", "day"])


def write_windows(readings: DataFrame, signals: DataFrame, out: str, seed: int = 42) -> DataFrame:
    """build_windows, written by split below out; refuses days in two splits. Gives the fingerprints by user and split."""
    from ..sources.writers import write_splits

    return write_splits(build_windows(readings, signals, seed), out, F.concat_ws("|", "user_id", "label_id", "state_val"))


def learning_curve(preds: DataFrame, iterations: int = 1000) -> DataFrame:
    """round, split, n, auc, ap, and the resampled auc_mean and auc_std, pooled over users; rows of all rounds (round null) are the ceiling."""
    from ..operators.metrics import average_precision, bootstrap_auc, roc_auc

    def rows(by: list[str]) -> DataFrame:
        exact = roc_auc(preds, by).select(*by, (F.col("n_pos") + F.col("n_neg")).alias("n"), "auc")
        return exact.join(average_precision(preds, by), by).join(bootstrap_auc(preds, by, iterations=iterations).drop("valid"), by)

    return rows(["round", "split"]).unionByName(rows(["split"]).withColumn("round", F.lit(None).cast("long")))


def experiment_rollup(summaries: DataFrame, predictions: DataFrame, pipelines: list[str]) -> dict[str, DataFrame]:
    """The newest result of each (uid, substance, task, pipeline) as tables: 'wide', 'grouped' by substance and task, 'long' (uid, pipeline, value)."""
    from ..operators.rollups import auc_wide_table, latest_per_key, unpivot_metrics

    keys = ["uid", "substance", "task", "pipeline"]
    newest = summaries.join(latest_per_key(summaries, keys), [*keys, "path"], "left_semi")
    wide = auc_wide_table(newest, predictions, pipelines)
    return {"wide": wide, "grouped": auc_wide_table(newest, predictions, pipelines, ["substance", "task"]), "long": unpivot_metrics(wide, "uid", "_mean")}


def experiment_rollup_of(spark: SparkSession, root: str, predictions: DataFrame, pipelines: list[str], name: str = "comparison_summary.csv") -> dict[str, DataFrame]:
    """experiment_rollup of every result file `name` below root, whichever header each has."""
    from ..sources.readers import read_summaries

    return experiment_rollup(written(read_summaries(spark, root, name), "summaries"), predictions, pipelines)


def fraction_vs_full(preds: DataFrame, frac: float, seeds: tuple[int, ...], iterations: int = 1000) -> DataFrame:
    """user_id, seed ('full_data' for all rows), n, auc, log_loss and the resampled auc_mean and auc_std of stratified samples and of everything.

    A sample has round(frac * n) of each user's rows, of both classes in proportion.
    """
    from ..operators.metrics import bootstrap_auc_of, by_score, log_loss, roc_auc_of
    from ..operators.splits import stratified_split

    preds = written(preds.select("user_id", "sample_id", "y_true", "y_score"), "predictions")
    parts = preds.select("user_id", F.lit("full_data").alias("seed"), "y_true", "y_score")
    for s in seeds:
        chosen = stratified_split(preds, frac, ["user_id", "y_true"], s, "sample_id", within=["user_id"]).where("chosen")
        parts = parts.unionByName(chosen.select("user_id", F.lit(str(s)).alias("seed"), "y_true", "y_score"))
    parts, by = written(parts, "fractions"), ["user_id", "seed"]  # read twice
    hist = written(by_score(parts, by), "fraction-counts")
    exact = roc_auc_of(hist, by).select(*by, (F.col("n_pos") + F.col("n_neg")).alias("n"), "auc")
    return exact.join(log_loss(parts, by), by).join(bootstrap_auc_of(hist, by, iterations=iterations).drop("valid"), by)
