"""Roll-ups of experiments and cohorts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def passing_thresholds(metrics: DataFrame, sens: float = 0.7, spec: float = 0.3) -> DataFrame:
    """Grid thresholds whose mean sensitivity and specificity are above the bounds."""
    m = metrics.groupBy("k").agg(F.avg("sensitivity").alias("sensitivity"), F.avg("specificity").alias("specificity"))
    return m.where((F.col("sensitivity") > sens) & (F.col("specificity") > spec))


def user_signal_stats(windows: DataFrame) -> DataFrame:
    """user_id, mean and sample deviation of the windows' means for both signals."""
    from .clean import seq_mean

    m = windows.select("user_id", seq_mean(F.col("hr_seq")).alias("hr"), seq_mean(F.col("st_seq")).alias("st"))
    return m.groupBy("user_id").agg(F.avg("hr").alias("hr_mean"), F.stddev_samp("hr").alias("hr_std"), F.avg("st").alias("st_mean"), F.stddev_samp("st").alias("st_std"))


def class_counts(rows: DataFrame, splits: tuple[str, ...] = ("train", "val", "test"), label: str = "state_val") -> DataFrame:
    """user_id, and for each split len, pos and neg in columns."""
    cell = lambda s, extra: F.sum((F.col("split") == s).cast("long") * extra)
    return rows.groupBy("user_id").agg(*[x for s in splits for x in (cell(s, F.lit(1)).alias(f"{s}_len"), cell(s, (F.col(label) == 1).cast("long")).alias(f"{s}_pos"), cell(s, (F.col(label) == 0).cast("long")).alias(f"{s}_neg"))])


def label_alignment(labels: DataFrame, windows: DataFrame) -> DataFrame:
    """user_id, split, raw and kept counts; 0 where a side has none."""
    a = labels.groupBy("user_id", "split").agg(F.count(F.lit(1)).alias("raw"))
    b = windows.groupBy("user_id", "split").agg(F.count(F.lit(1)).alias("kept"))
    return a.join(b, ["user_id", "split"], "full_outer").na.fill(0, ["raw", "kept"])


def split_summary(before: DataFrame, after: DataFrame, label: str = "state_val") -> DataFrame:
    """user_id (null: all users), orig and new pos and neg, added, removed: by rollup."""
    both = before.select("user_id", label, F.lit(0).alias("_s")).unionByName(after.select("user_id", label, F.lit(1).alias("_s")))
    cell = lambda s, v: F.sum(((F.col("_s") == s) & (F.col(label) == v)).cast("long"))
    c = both.rollup("user_id").agg(cell(0, 1).alias("orig_pos"), cell(0, 0).alias("orig_neg"), cell(1, 1).alias("new_pos"), cell(1, 0).alias("new_neg"))
    diff = F.col("new_pos") + F.col("new_neg") - F.col("orig_pos") - F.col("orig_neg")
    return c.withColumn("added", F.greatest(diff, F.lit(0))).withColumn("removed", F.greatest(-diff, F.lit(0)))


def shared_seed_runs(runs: DataFrame, seed: str, method: str) -> DataFrame:
    """Runs whose seed occurs for every method."""
    methods = runs.agg(F.countDistinct(method).alias("_m"))
    seeds = runs.groupBy(seed).agg(F.countDistinct(method).alias("_n")).crossJoin(F.broadcast(methods)).where("_n = _m")  # one row
    return runs.join(seeds.select(seed), seed, "left_semi")


def mean_std_per_round(progress: DataFrame) -> DataFrame:
    """method, round, mean and sample deviation of auc over seeds, mean auc_std, upper bound."""
    g = progress.groupBy("method", "round").agg(F.avg("auc").alias("auc_mean"), F.stddev_samp("auc").alias("auc_std"), F.avg("auc_sd").alias("mean_sd"))
    return g.withColumn("upper", F.col("auc_mean") + F.col("mean_sd"))


def final_round_summary(progress: DataFrame) -> DataFrame:
    """method, mean, sample deviation and number of the auc in each seed's last round."""
    last = progress.groupBy("seed", "method").agg(F.max_by("auc", "round").alias("auc"))
    return last.groupBy("method").agg(F.avg("auc").alias("auc_mean"), F.stddev_samp("auc").alias("auc_std"), F.count(F.lit(1)).alias("n"))


def queried_counts(queried: DataFrame, users: list) -> DataFrame:
    """round, and a column u<user> with the number of picks for each user; 0 where none."""
    wide = queried.groupBy("round").pivot("user_id", users).agg(F.count(F.lit(1))).na.fill(0)
    return wide.select("round", *[F.col(f"`{u}`").alias(f"u{u}") for u in users])


def binned_cumulative_counts(counts: DataFrame, size: int) -> DataFrame:
    """user_id, bin, total, running: sums by round bin and their running total. counts: user_id, round, n."""
    b = counts.groupBy("user_id", F.floor((F.col("round") - 1) / size).cast("long").alias("bin")).agg(F.sum("n").alias("total"))
    return b.withColumn("running", F.sum("total").over(W.partitionBy("user_id").orderBy("bin")))


def pivot_runs(runs: DataFrame, run: str, method: str, value: str, methods: list[str]) -> DataFrame:
    """run x method table of values, with rows 'mean' and 'std'."""
    wide = runs.groupBy(F.col(run).cast("string").alias("run")).pivot(method, methods).agg(F.avg(value))
    stat = lambda name, f: wide.agg(*[f(F.col(f"`{m}`")).alias(m) for m in methods]).select(F.lit(name).alias("run"), *[F.col(f"`{m}`") for m in methods])
    return wide.unionByName(stat("mean", F.avg)).unionByName(stat("std", F.stddev_samp))


def unpivot_metrics(wide: DataFrame, key: str, suffix: str) -> DataFrame:
    """key, pipeline, value of the columns that end in suffix; values that are no numbers are left out."""
    columns = [c for c in wide.columns if c.endswith(suffix)]
    text = wide.select(key, *[F.col(c).cast("string").alias(c.removesuffix(suffix)) for c in columns])
    long = text.unpivot([key], [c.removesuffix(suffix) for c in columns], "pipeline", "value")
    return long.withColumn("value", F.expr("try_cast(value AS double)")).where("value is not null")


def numeric_id(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "").try_cast("long")


def sort_by_numeric_id(df: DataFrame, column: str) -> DataFrame:
    """Rows in the order of the digits in an id, ids without digits last."""
    return df.orderBy(numeric_id(F.col(column)).asc_nulls_last(), column)


def auc_wide_table(summaries: DataFrame, predictions: DataFrame, pipelines: list[str], by: list[str] = (), iterations: int = 1000) -> DataFrame:
    """by, uid, and for each pipeline <p>_train, <p>_mean and <p>_std: numbers, or where null the parts of an 'm ± s' text.

    Of several rows of a cell, the first non-null by path counts. The row AGGREGATED holds the resampled auc of all
    users' predictions together (by, pipeline, y_true, y_score), not a mean over users, and no train auc.
    """
    from ..functions.scalars import parse_mean_std
    from .metrics import bootstrap_auc

    mean, std = parse_mean_std(F.col("auc_text"))
    s = summaries.withColumn("_m", F.coalesce("auc_mean", mean)).withColumn("_s", F.coalesce("auc_std", std))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("path")))
    cells = s.groupBy(*by, "uid", "pipeline").agg(first("auc_train").alias("train"), first("_m").alias("mean"), first("_s").alias("std"))
    pooled = bootstrap_auc(predictions, [*by, "pipeline"], iterations=iterations)
    pooled = pooled.select(*by, F.lit("AGGREGATED").alias("uid"), "pipeline", F.lit(None).cast("double").alias("train"), F.col("auc_mean").alias("mean"), F.col("auc_std").alias("std"))
    if by:
        pooled = pooled.join(cells.select(*by).distinct(), list(by), "left_semi")
    return cells.unionByName(pooled).groupBy(*by, "uid").pivot("pipeline", pipelines).agg(*[F.first(c).alias(c) for c in ("train", "mean", "std")])


def feature_correlation(df: DataFrame, columns: list[str], cut: float = 0.85) -> DataFrame:
    """a, b, corr for pairs of columns with |Pearson| above the cut; one pass over df."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    long = row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("corr")) for a, b in pairs])).alias("x")).select("x.*")
    return long.where(F.abs("corr") > cut)


def split_fingerprint(df: DataFrame, by: list[str], line: Column) -> DataFrame:
    """by, rows, sha256 of the sorted lines joined by newlines.

    A group's lines are gathered: for groups of bounded size (a user's split). For more use fingerprint_of_groups.
    """
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("sha256"))


def fingerprint_of_groups(prints: DataFrame, by: list[str]) -> DataFrame:
    """by, sha256 over the sorted sha256 of smaller groups."""
    return prints.groupBy(*by).agg(F.sum("rows").alias("rows"), F.sha2(F.array_join(F.array_sort(F.collect_list("sha256")), "\n"), 256).alias("sha256"))


def representation_means(df: DataFrame, by: str, vector: str) -> DataFrame:
    """by, pos, mean: the mean vector of each group in long form."""
    return df.select(by, F.posexplode(vector)).groupBy(by, F.col("pos").cast("long").alias("pos")).agg(F.avg("col").alias("mean"))


def representation_plane(means: DataFrame, by: str) -> DataFrame:
    """by, x, y: the groups' mean vectors (by, pos, mean) on the plane of their two first principal components.

    Components come from the covariance of the means, whose size is a vector's width squared; each points to where its
    largest coordinate is positive, so that reruns agree. One group, or means that are all alike, lie at 0.
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    center = means.groupBy("pos").agg(F.avg("mean").alias("_c"))
    centered = means.join(center, "pos").select(by, "pos", (F.col("mean") - F.col("_c")).alias("mean"))
    wide = centered.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "mean"))), lambda x: x["mean"]).alias("_v"))  # a vector's width
    data = wide.select(by, array_to_vector("_v").alias("_features")).cache()
    try:
        if data.count() < 2:
            return means.select(by).distinct().select(by, F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
        model = PCA(k=2, inputCol="_features", outputCol="_low").fit(data)
        turn = [1.0 if c[abs(c).argmax()] >= 0 else -1.0 for c in model.pc.toArray().T]
        low = model.transform(data).select(by, vector_to_array("_low").alias("_low"))
        return low.select(by, *[(F.col("_low")[i] * turn[i]).alias(n) for i, n in enumerate("xy")])
    finally:
        data.unpersist()


def merge_round_metrics(counts: DataFrame, pooled: DataFrame) -> DataFrame:
    return counts.join(pooled, "round", "left")


def upsert_user_results(existing: DataFrame, new: DataFrame, key: str = "user_id") -> DataFrame:
    """Rows of users in `new` replace theirs in `existing`; columns may be missing on either side."""
    return existing.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def pool_users(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def latest_per_key(files: DataFrame, keys: list[str], path: str = "path", time: str = "mtime") -> DataFrame:
    """keys, path: the newest file of each key, ties to the larger path."""
    return files.groupBy(*keys).agg(F.max(F.struct(time, path))[path].alias(path))


def aligned_pairs(probs: DataFrame, labels: DataFrame) -> DataFrame:
    """user_id, pos, y_score, y_true of users with as many probabilities as labels."""
    p = probs.groupBy("user_id").agg(F.count(F.lit(1)).alias("_n"))
    n = labels.groupBy("user_id").agg(F.count(F.lit(1)).alias("_n"))
    return probs.join(labels, ["user_id", "pos"]).join(p.join(n, ["user_id", "_n"]), "user_id", "left_semi")
