"""Metrics of predictions (y_true, y_score), by group: ranking, thresholds, resampling, ensembles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.paths import written
from .quantiles import exact_quantiles
from .resampling import PRIME, auc_by_iteration, auc_moments, auc_parts, draw_rows, joined_moments, resample, resampled  # noqa: F401

#: Thresholds 0, 0.01, ..., 1, as literals k / 100.
GRID = 100
#: Score buckets of a running sum, so that a group's rows need not meet in one task.
BUCKETS = 1000


def running(df: DataFrame, by: list[str], order: str, sums: list[str], descending: bool = False) -> DataFrame:
    """df with before_<c> for each c of `sums`: its sum over the group's rows that come earlier in `order`.

    Two levels: inside score buckets, and over the buckets' totals (at most BUCKETS + 2 a group).
    """
    bucket = F.least(F.greatest(F.floor(F.col(order) * BUCKETS), F.lit(-1)), F.lit(BUCKETS)).cast("int")
    rows = df.withColumn("_b", bucket)
    way = (lambda c: F.col(c).desc()) if descending else F.col
    totals = rows.groupBy(*by, "_b").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    past = W.partitionBy(*by).orderBy(way("_b")).rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(*by, "_b", *[F.coalesce(F.sum(f"_t_{c}").over(past), F.lit(0)).alias(f"_o_{c}") for c in sums])
    inside = W.partitionBy(*by, "_b").orderBy(way(order)).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_i_{c}") for c in sums]).join(starts, [*by, "_b"])
    return rows.select(*df.columns, *[(F.col(f"_i_{c}") + F.col(f"_o_{c}")).alias(f"before_{c}") for c in sums])


def by_score(preds: DataFrame, by: list[str], weight: Column | None = None) -> DataFrame:
    """One row for each group and distinct score: pos, neg."""
    w = F.lit(1) if weight is None else weight
    return preds.groupBy(*by, "y_score").agg(F.sum(F.when(F.col("y_true") == 1, w).otherwise(0)).alias("pos"), F.sum(F.when(F.col("y_true") == 1, 0).otherwise(w)).alias("neg"))


def _grouped(preds: DataFrame, by: list[str]) -> tuple[DataFrame, list[str], bool]:
    """Without a group a constant one, so that windows always have a key."""
    return (preds, by, False) if by else (preds.withColumn("_all", F.lit(0)), ["_all"], True)


def roc_auc(preds: DataFrame, by: list[str], weight: Column | None = None) -> DataFrame:
    """by, auc, n_pos, n_neg: tie-aware area; null where a group has one class."""
    preds, keys, pooled = _grouped(preds, by)
    out = roc_auc_of(by_score(preds, keys, weight), keys)
    return out.drop("_all") if pooled else out


def roc_auc_of(hist: DataFrame, keys: list[str]) -> DataFrame:
    """roc_auc from by_score's rows."""
    r = running(hist, keys, "y_score", ["neg"])
    out = r.groupBy(*keys).agg(F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2)).alias("_u"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return out.withColumn("auc", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("_u") / (F.col("n_pos").cast("double") * F.col("n_neg")))).drop("_u")


def average_precision(preds: DataFrame, by: list[str]) -> DataFrame:
    preds, keys, pooled = _grouped(preds, by)
    r = running(by_score(preds, keys), keys, "y_score", ["pos", "neg"], descending=True)
    tp = F.col("before_pos") + F.col("pos")
    out = r.groupBy(*keys).agg((F.sum(F.col("pos") * tp / (tp + F.col("before_neg") + F.col("neg"))) / F.sum("pos")).alias("ap"))
    return out.drop("_all") if pooled else out


def log_loss(preds: DataFrame, by: list[str], eps: float = 1e-15) -> DataFrame:
    p = F.least(F.greatest(F.col("y_score"), F.lit(eps)), F.lit(1 - eps))
    return preds.groupBy(*by).agg(F.avg(-(F.col("y_true") * F.log(p) + (1 - F.col("y_true")) * F.log(1 - p))).alias("log_loss"))


def roc_curve(preds: DataFrame, by: list[str]) -> DataFrame:
    """by, threshold, fpr, tpr at each distinct score, and (null, 0, 0) to begin with."""
    r = running(by_score(preds, by), by, "y_score", ["pos", "neg"], descending=True)
    totals = preds.groupBy(*by).agg(F.sum("y_true").alias("_p"), F.sum(1 - F.col("y_true")).alias("_n"))
    points = r.join(totals, by).select(*by, F.col("y_score").alias("threshold"), ((F.col("before_neg") + F.col("neg")) / F.col("_n")).alias("fpr"), ((F.col("before_pos") + F.col("pos")) / F.col("_p")).alias("tpr"))
    zero = totals.select(*by, F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return points.unionByName(zero)


def confusion_at(preds: DataFrame, by: list[str]) -> DataFrame:
    """by, k, tp, fp, tn, fn, sensitivity, specificity, accuracy with score >= k / 100 as positive, k = 0..100.

    A histogram over the grid and sums over its bins; rows never meet the thresholds.
    """
    preds, keys, pooled = _grouped(preds, by)
    k = F.least(F.floor(F.col("y_score") * GRID + 1e-9), F.lit(GRID)).cast("long")
    counts = preds.groupBy(*keys, k.alias("k")).agg(F.sum("y_true").alias("p"), F.sum(1 - F.col("y_true")).alias("n"))
    every = counts.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(-1).cast("long"), F.lit(GRID).cast("long"))).alias("k"))
    counts = every.join(counts.withColumn("k", F.greatest("k", F.lit(-1))).groupBy(*keys, "k").agg(F.sum("p").alias("p"), F.sum("n").alias("n")), [*keys, "k"], "left").na.fill(0)
    up = W.partitionBy(*keys).orderBy(F.desc("k")).rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(*keys)
    c = counts.select(*keys, "k", F.sum("p").over(up).alias("tp"), F.sum("n").over(up).alias("fp"), F.sum("p").over(whole).alias("_p"), F.sum("n").over(whole).alias("_n"))
    c = c.where("k >= 0").withColumn("fn", F.col("_p") - F.col("tp")).withColumn("tn", F.col("_n") - F.col("fp"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    c = c.withColumn("sensitivity", ratio(F.col("tp"), F.col("_p"))).withColumn("specificity", ratio(F.col("tn"), F.col("_n"))).withColumn("accuracy", ratio(F.col("tp") + F.col("tn"), F.col("_p") + F.col("_n")))
    out = c.drop("_p", "_n")
    return out.drop("_all") if pooled else out


def best_threshold(preds: DataFrame, by: list[str], value: Column, allowed: Column | None = None, default: float = 0.5) -> DataFrame:
    """by, threshold, best: the smallest grid threshold with the largest value (rounded to 12 places), or the default."""
    c = confusion_at(preds, by)
    v = F.round(value, 12)
    v = v if allowed is None else F.when(allowed, v)
    best = c.groupBy(*by).agg(F.max(F.when(v.isNotNull(), F.struct(v.alias("v"), (-F.col("k")).alias("k")))).alias("b"))
    return best.select(*by, F.coalesce(-F.col("b.k") / float(GRID), F.lit(default)).alias("threshold"), F.col("b.v").alias("best"))


def select_threshold(preds: DataFrame, by: list[str]) -> DataFrame:
    """Largest 0.7 * sensitivity + 0.3 * specificity where both classes are predicted."""
    predicted, rest = F.col("tp") + F.col("fp"), F.col("tn") + F.col("fn")
    return best_threshold(preds, by, 0.7 * F.col("sensitivity") + 0.3 * F.col("specificity"), (predicted > 0) & (rest > 0))


def best_f1(preds: DataFrame, by: list[str]) -> DataFrame:
    """Largest F1 over 0.05, 0.10, ..., 0.95; the first wins."""
    f1 = F.when(2 * F.col("tp") + F.col("fp") + F.col("fn") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0.0)
    return best_threshold(preds, by, f1, (F.col("k") % 5 == 0) & F.col("k").between(5, 95))


def youden_threshold(preds: DataFrame, by: list[str]) -> DataFrame:
    return best_threshold(preds, by, F.col("sensitivity") + F.col("specificity") - 1)


def balanced_operating_point(metrics: DataFrame, by: list[str]) -> DataFrame:
    """by, k, sensitivity, specificity: largest smaller one of the two, then largest sensitivity, then smallest k."""
    best = F.max(F.struct(F.round(F.least("sensitivity", "specificity"), 12).alias("m"), F.round("sensitivity", 12).alias("s"), (-F.col("k")).alias("k"), "specificity")).alias("b")
    return metrics.groupBy(*by).agg(best).select(*by, (-F.col("b.k")).alias("k"), F.col("b.s").alias("sensitivity"), F.col("b.specificity").alias("specificity"))


def class_weights(df: DataFrame, by: list[str], label: str = "y_true") -> DataFrame:
    """by, label, class_weight n / (k * count) (1 where one class), scale_pos_weight neg / pos."""
    c = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy(*by)
    k = F.count(F.lit(1)).over(w)
    pos, neg = F.sum(F.when(F.col(label) == 1, F.col("n"))).over(w), F.sum(F.when(F.col(label) == 0, F.col("n"))).over(w)
    return c.select(*by, label, F.when(k > 1, F.sum("n").over(w) / (k * F.col("n"))).otherwise(1.0).alias("class_weight"), (neg / pos).alias("scale_pos_weight"))


def auc_of(pos: np.ndarray, neg: np.ndarray) -> np.ndarray:
    """Tie-aware area of each row of counts by score; nan where a class is absent."""
    below = np.cumsum(neg, axis=1) - neg
    with np.errstate(invalid="ignore", divide="ignore"):
        return (pos * (below + neg / 2)).sum(axis=1) / (pos.sum(axis=1).astype(float) * neg.sum(axis=1))


def bootstrap_auc(preds: DataFrame, by: list[str], frac: float = 0.7, iterations: int = 1000, seed: int = 42) -> DataFrame:
    """by, auc_mean, auc_std (sample), valid: over the iterations that drew both classes, of round(frac * n) rows with replacement.

    Groups with a null key are left out.
    """
    preds, keys, pooled = _grouped(preds, by)
    out = bootstrap_auc_of(by_score(preds, keys), keys, frac, iterations, seed)
    return out.drop("_all") if pooled else out


def bootstrap_auc_of(hist: DataFrame, keys: list[str], frac: float = 0.7, iterations: int = 1000, seed: int = 42) -> DataFrame:
    """bootstrap_auc from by_score's rows."""
    moments = (lambda s, p, q: auc_moments(p, q), "count long, mean double, m2 double")
    parts, tall = resample(hist, keys, lambda s, p, q: auc_parts(p, q), "p long, n long, u double", frac, iterations, seed, moments)
    if tall:
        each = auc_by_iteration(parts, keys, tall)
        out = each.groupBy(*keys).agg(F.avg("auc").alias("auc_mean"), F.stddev_samp("auc").alias("auc_std"), (F.count("auc") / iterations).alias("valid"))
    else:
        n, std = F.col("count"), F.sqrt(F.col("m2") / F.greatest(F.col("count") - 1, F.lit(1)))
        out = joined_moments(parts, keys).select(*keys, F.when(n > 0, F.col("mean")).alias("auc_mean"), F.when(n > 1, std).alias("auc_std"), (n / iterations).alias("valid"))
    return out


THRESHOLD_METRICS = ("sensitivity", "specificity", "accuracy")


def bootstrap_thresholds(preds: DataFrame, by: list[str], frac: float = 0.7, iterations: int = 1000, seed: int = 42) -> DataFrame:
    """by, k, mean and sample deviation of sensitivity, specificity and accuracy at score >= k / 100, and of the auc, over the same draws."""
    below, auc_row = -1, -2  # scores under every threshold; the row of the auc

    def measure(scores: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> dict[str, np.ndarray]:
        grid = np.clip(np.floor(scores * GRID + 1e-9), below, GRID).astype(np.int64)  # scores are in order
        bins, first = np.unique(grid, return_index=True)
        counts = {"at": np.repeat(np.arange(len(pos)), len(bins)), "k": np.tile(bins, len(pos)), "p": np.add.reduceat(pos, first, axis=1).ravel(), "n": np.add.reduceat(neg, first, axis=1).ravel()}
        area = auc_parts(pos, neg) | {"k": np.full(len(pos), auc_row)}
        return {c: np.concatenate((counts.get(c, np.zeros(len(counts["at"]))), v)) for c, v in area.items()}

    def finish(rows: pd.DataFrame) -> pd.DataFrame:
        """A group's rows: an iteration and a bin each, so no more than iterations times bins."""
        p, n = (np.zeros((iterations, GRID + 2)) for _ in "pn")
        for x, c in ((p, "p"), (n, "n")):
            x[rows["iteration"], rows["k"] + 1] = rows[c]
        fn, tn = (np.cumsum(x, axis=1)[:, :-1] for x in (p, n))
        p, n = p.sum(axis=1, keepdims=True), n.sum(axis=1, keepdims=True)
        with np.errstate(invalid="ignore", divide="ignore"):
            values = (np.where(p > 0, (p - fn) / p, 0.0), np.where(n > 0, tn / n, 0.0), (p - fn + tn) / (p + n))
        out = pd.DataFrame({c: rows[c].iloc[0] for c in by} | {"k": np.arange(GRID + 1)})
        for name, v in zip(THRESHOLD_METRICS, values, strict=True):
            out[f"{name}_mean"], out[f"{name}_std"] = v.mean(axis=0), v.std(axis=0, ddof=1) if iterations > 1 else np.nan
        return out

    found, tall = resample(by_score(preds, by), by, measure, "k long, p long, n long, u double", frac, iterations, seed)
    found = written(found, "drawn")
    auc = auc_by_iteration(found.where(F.col("k") == auc_row).drop("k"), by, tall).groupBy(*by).agg(F.avg("auc").alias("auc_mean"), F.stddev_samp("auc").alias("auc_std"))
    bins = found.where(F.col("k") > auc_row).groupBy(*by, "iteration", "k").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    names = [f"{m}_{x}" for m in THRESHOLD_METRICS for x in ("mean", "std")]
    types = ", ".join(f"`{c}` {dict(preds.dtypes)[c]}" for c in by)
    done = bins.groupBy(*by).applyInPandas(finish, f"{types}, k long, " + ", ".join(f"{c} double" for c in names))
    return done.select(*by, "k", *[F.nanvl(c, F.lit(None)).alias(c) for c in names]).join(auc, by)


def ensemble_weight_grid(preds: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """by, alpha_k, auc of (k / 10) * a + (1 - k / 10) * b, k = 0..10, scores rounded to 9 places."""
    ks = preds.withColumn("alpha_k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(10).cast("long"))))
    mixed = ks.withColumn("y_score", F.round(F.col("alpha_k") / 10.0 * F.col(a) + (1 - F.col("alpha_k") / 10.0) * F.col(b), 9))
    return roc_auc(mixed, [*by, "alpha_k"]).select(*by, "alpha_k", "auc")


def mc_stats(mc: DataFrame, eps: float = 1e-8) -> DataFrame:
    """sample_id, mean, population std, predictive and expected entropy, their difference (BALD) over passes."""
    entropy = lambda p: -(p * F.log(p + eps) + (1 - p) * F.log(1 - p + eps))
    m = mc.groupBy("sample_id").agg(F.avg("prob").alias("mean"), F.stddev_pop("prob").alias("std"), F.var_pop("prob").alias("var"), F.avg(entropy(F.col("prob"))).alias("expected_entropy"))
    return m.withColumn("predictive_entropy", entropy(F.col("mean"))).withColumn("bald", F.col("predictive_entropy") - F.col("expected_entropy"))


def ensemble_variance(mc: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sample_id, mean, var, std over passes; one row mean_var, median_var, mean_std over all samples)."""
    each = written(mc_stats(mc).select("sample_id", "mean", "var", "std"), "ensemble")
    median = exact_quantiles(each, {"var": (F.col("var"), [0.5])})["var"][0]
    return each, each.agg(F.avg("var").alias("mean_var"), F.avg("std").alias("mean_std")).select("mean_var", F.lit(median).cast("double").alias("median_var"), "mean_std")


def pooled_auc_per_round(progress: DataFrame, preds: DataFrame, full: DataFrame, iterations: int = 1000, seed: int = 42) -> DataFrame:
    """round, split, num_labeled, total and pct averaged over users, auc_mean and auc_std resampled from all users' predictions.

    progress: user_id, round, num_labeled, total. The row of the model on full data has round null, split 'full', all
    users' rows (each user's total in its first round) and the resampled auc of `full`, its predictions.
    """
    pct = 100.0 * F.col("num_labeled") / F.when(F.col("total") > 0, F.col("total"))
    counts = progress.groupBy("round").agg(F.avg("num_labeled").alias("num_labeled"), F.avg("total").alias("total"), F.avg(pct).alias("pct"))
    pooled = bootstrap_auc(preds, ["round", "split"], iterations=iterations, seed=seed).select("round", "split", "auc_mean", "auc_std")
    totals = progress.groupBy("user_id").agg(F.min_by("total", "round").alias("total")).agg(F.sum("total").cast("double").alias("total"))
    ceiling = bootstrap_auc(full.withColumn("split", F.lit("full")), ["split"], iterations=iterations, seed=seed).select("split", "auc_mean", "auc_std")
    last = ceiling.crossJoin(F.broadcast(totals)).select(F.lit(None).cast("long").alias("round"), "split", F.col("total").alias("num_labeled"), "total", F.lit(100.0).alias("pct"), "auc_mean", "auc_std")  # one row each
    return counts.join(pooled, "round", "left").select("round", "split", "num_labeled", "total", "pct", "auc_mean", "auc_std").unionByName(last)
