"""Queries of metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from ..functions.scalars import hp_folder  # noqa: F401
from ..hashing import hash_unit
from ..operators import metrics as M
from ..registry import query, r6

AUC = """sum(pos * (coalesce(nb, 0) + neg / 2)) / (CAST(sum(pos) AS DOUBLE) * sum(neg))"""


def auc_sql(source: str, by: str, weight: str = "1", extra: str = "") -> str:
    return f""", sc AS (SELECT {by}, y_score, CAST(sum(CASE WHEN y_true = 1 THEN {weight} ELSE 0 END) AS DOUBLE) AS pos, CAST(sum(CASE WHEN y_true = 1 THEN 0 ELSE {weight} END) AS DOUBLE) AS neg FROM {source} GROUP BY {by}, y_score),
cu AS (SELECT *, sum(neg) OVER (PARTITION BY {by} ORDER BY y_score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS nb FROM sc),
au AS (SELECT {by}, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN {AUC} END AS auc FROM cu GROUP BY {by}){extra}"""


@query("d5_class_weights", """, c AS (SELECT user_id, y_true, count(*) AS n FROM preds GROUP BY ALL)
SELECT user_id, y_true, round(CASE WHEN count(*) OVER w > 1 THEN sum(n) OVER w / (count(*) OVER w * n) ELSE 1 END, 6) AS class_weight,
round((sum(n) FILTER (WHERE y_true = 0) OVER w) / (sum(n) FILTER (WHERE y_true = 1) OVER w), 6) AS scale_pos_weight FROM c WINDOW w AS (PARTITION BY user_id)""")
def d5(spark, d):
    w = M.class_weights(X.preds(spark, d), ["user_id"])
    return w.select("user_id", "y_true", r6("class_weight").alias("class_weight"), r6("scale_pos_weight").alias("scale_pos_weight"))


@query("d7_roc_auc", auc_sql("preds", "user_id, split") + " SELECT user_id, split, round(auc, 6) AS auc FROM au")
def d7(spark, d):
    return M.roc_auc(X.preds(spark, d), ["user_id", "split"]).select("user_id", "split", r6("auc").alias("auc"))


@query("d8_flipped_auc", ", flip AS (SELECT user_id, y_true, 1 - y_score AS y_score FROM preds)" + auc_sql("flip", "user_id") + """
SELECT user_id, round(auc, 6) AS flipped_auc, round(avg(y_score) FILTER (WHERE y_true = 1), 6) AS mean_pos, round(avg(y_score) FILTER (WHERE y_true = 0), 6) AS mean_neg, min(y_score) AS lo, max(y_score) AS hi FROM au JOIN preds USING (user_id) GROUP BY user_id, auc""")
def d8(spark, d):
    p = X.preds(spark, d)
    a = M.roc_auc(p.withColumn("y_score", F.round(1 - F.col("y_score"), 9)), ["user_id"]).select("user_id", r6("auc").alias("flipped_auc"))
    s = p.groupBy("user_id").agg(r6(F.avg(F.when(F.col("y_true") == 1, F.col("y_score")))).alias("mean_pos"), r6(F.avg(F.when(F.col("y_true") == 0, F.col("y_score")))).alias("mean_neg"), F.min("y_score").alias("lo"), F.max("y_score").alias("hi"))
    return a.join(s, "user_id")


@query("d9_average_precision", """, sc AS (SELECT user_id, y_score, sum(y_true) AS p, count(*) AS n FROM preds GROUP BY ALL),
cu AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS k FROM sc WINDOW w AS (PARTITION BY user_id ORDER BY y_score DESC))
SELECT user_id, round(sum(p * tp / k) / sum(p), 6) AS ap FROM cu GROUP BY user_id""")
def d9(spark, d):
    return M.average_precision(X.preds(spark, d), ["user_id"]).select("user_id", r6("ap").alias("ap"))


@query("d10_log_loss", """SELECT user_id, round(avg(-(y_true * ln(p) + (1 - y_true) * ln(1 - p))), 6) AS log_loss FROM (SELECT *, least(greatest(y_score, 1e-15), 1 - 1e-15) AS p FROM preds) GROUP BY user_id""")
def d10(spark, d):
    return M.log_loss(X.preds(spark, d), ["user_id"]).select("user_id", r6("log_loss").alias("log_loss"))


@query("d11_roc_curve", """, sc AS (SELECT user_id, y_score, sum(y_true) AS p, sum(1 - y_true) AS n FROM preds GROUP BY ALL),
t AS (SELECT user_id, sum(p) AS tp, sum(n) AS tn FROM sc GROUP BY user_id)
SELECT user_id, y_score AS threshold, round(sum(n) OVER w / tn, 6) AS fpr, round(sum(p) OVER w / tp, 6) AS tpr FROM sc JOIN t USING (user_id) WINDOW w AS (PARTITION BY user_id ORDER BY y_score DESC)
UNION ALL SELECT user_id, NULL, 0, 0 FROM t""")
def d11(spark, d):
    return M.roc_curve(X.preds(spark, d), ["user_id"]).select("user_id", "threshold", r6("fpr").alias("fpr"), r6("tpr").alias("tpr"))


CONFUSION = """, k AS (SELECT unnest(range(0, 101)) AS k),
cf AS (SELECT user_id, k, count(*) FILTER (WHERE y_true = 1 AND y_score >= k / 100.0::DOUBLE) AS tp, count(*) FILTER (WHERE y_true = 0 AND y_score >= k / 100.0::DOUBLE) AS fp,
count(*) FILTER (WHERE y_true = 0 AND y_score < k / 100.0::DOUBLE) AS tn, count(*) FILTER (WHERE y_true = 1 AND y_score < k / 100.0::DOUBLE) AS fn FROM preds, k GROUP BY user_id, k),
m AS (SELECT *, coalesce(tp / nullif(tp + fn, 0), 0) AS sens, coalesce(tn / nullif(tn + fp, 0), 0) AS spec, (tp + tn) / (tp + fp + tn + fn) AS acc FROM cf)"""


@query("d12_confusion", CONFUSION + " SELECT user_id, k, tp, fp, tn, fn, round(sens, 6) AS sensitivity, round(spec, 6) AS specificity, round(acc, 6) AS accuracy FROM m")
def d12(spark, d):
    c = M.confusion_at(X.preds(spark, d), ["user_id"])
    return c.select("user_id", "k", "tp", "fp", "tn", "fn", *[r6(x).alias(x) for x in ("sensitivity", "specificity", "accuracy")])


@query("c13_threshold_grid", CONFUSION + " SELECT k, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp FROM m GROUP BY k")
def c13(spark, d):
    return M.confusion_at(X.preds(spark, d), []).select("k", "tp", "fp")


@query("b13_passing_thresholds", CONFUSION + " SELECT k FROM m GROUP BY k HAVING avg(sens) > 0.7 AND avg(spec) > 0.2")
def b13(spark, d):
    from ..operators.rollups import passing_thresholds

    return passing_thresholds(M.confusion_at(X.preds(spark, d), ["user_id"]), 0.7, 0.2).select("k")


def pick(value: str, where: str = "true") -> str:
    return f", v AS (SELECT user_id, k, round({value}, 12) AS v FROM m WHERE {where}), b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY v DESC, k) AS rk FROM v) SELECT user_id, k / 100.0::DOUBLE AS threshold, round(v, 6) AS best FROM b WHERE rk = 1"


def _best(df):
    return df.select("user_id", "threshold", r6("best").alias("best"))


@query("d13_select_threshold", CONFUSION + pick("0.7::DOUBLE * sens + 0.3::DOUBLE * spec", "tp + fp > 0 AND tn + fn > 0"))
def d13(spark, d):
    return _best(M.select_threshold(X.preds(spark, d), ["user_id"]))


@query("d14_best_f1", CONFUSION + pick("coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)", "k % 5 = 0 AND k BETWEEN 5 AND 95"))
def d14(spark, d):
    return _best(M.best_f1(X.preds(spark, d), ["user_id"]))


@query("d15_youden", CONFUSION + pick("sens + spec - 1"))
def d15(spark, d):
    return _best(M.youden_threshold(X.preds(spark, d), ["user_id"]))


@query("d16_balanced_point", CONFUSION + ", b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(least(sens, spec), 12) DESC, round(sens, 12) DESC, k) AS rk FROM m) SELECT user_id, k, round(sens, 6) AS sensitivity, round(spec, 6) AS specificity FROM b WHERE rk = 1")
def d16(spark, d):
    b = M.balanced_operating_point(M.confusion_at(X.preds(spark, d), ["user_id"]), ["user_id"])
    return b.select("user_id", "k", r6("sensitivity").alias("sensitivity"), r6("specificity").alias("specificity"))


def boot(by: str, group: str, source: str = "preds", it: int = 1000, name: str = "") -> str:
    """Resampling by single draws: ix{name} rows, dr{name} (by, iteration, i), hs{name} counts by score, ba{name} (by, iteration, auc)."""
    md5 = f"md5('42:' || {group} || ':' || iteration)"
    number = lambda at: f"CAST('0x' || substr({md5}, {at}, 8) AS BIGINT) % 2147483647"
    return f""", ix{name} AS (SELECT {by}, y_score, y_true, row_number() OVER (PARTITION BY {by} ORDER BY y_score, y_true) - 1 AS i FROM {source}),
sd{name} AS (SELECT {by}, n, iteration, {number(1)} AS a, {number(9)} AS b, {number(17)} AS c FROM (SELECT {by}, count(*) AS n FROM {source} GROUP BY {by}), (SELECT unnest(range(0, {it})) AS iteration)),
xs{name} AS (SELECT {by}, n, iteration, c, (a * j + b) % 2147483647 AS x FROM (SELECT *, unnest(range(1, CAST(round_even(0.7 * n, 0) AS BIGINT) + 1)) AS j FROM sd{name})),
dr{name} AS (SELECT {by}, iteration, (((x * x % 2147483647) * (x * x % 2147483647) % 2147483647 * x + c) % 2147483647) % n AS i FROM xs{name}),
hs{name} AS (SELECT {by}, iteration, y_score, CAST(count(*) FILTER (WHERE y_true = 1) AS DOUBLE) AS pos, CAST(count(*) FILTER (WHERE y_true = 0) AS DOUBLE) AS neg FROM dr{name} JOIN ix{name} USING ({by}, i) GROUP BY {by}, iteration, y_score),
bc{name} AS (SELECT *, sum(neg) OVER (PARTITION BY {by}, iteration ORDER BY y_score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS nb FROM hs{name}),
ba{name} AS (SELECT {by}, iteration, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN {AUC} END AS auc FROM bc{name} GROUP BY {by}, iteration),
bs{name} AS (SELECT {by}, avg(auc) AS auc_mean, stddev_samp(auc) AS auc_std, count(auc) / 1000 AS valid FROM ba{name} GROUP BY {by})"""


def rank_sql(by: str, source: str = "preds", name: str = "") -> str:
    """rk{name}: by, n, auc, ap."""
    return f""", qq{name} AS (SELECT {by}, y_score, CAST(sum(y_true) AS DOUBLE) AS pos, CAST(sum(1 - y_true) AS DOUBLE) AS neg FROM {source} GROUP BY {by}, y_score),
qw{name} AS (SELECT *, sum(neg) OVER (PARTITION BY {by} ORDER BY y_score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS nb, sum(pos) OVER (PARTITION BY {by} ORDER BY y_score DESC) AS tp, sum(pos + neg) OVER (PARTITION BY {by} ORDER BY y_score DESC) AS k FROM qq{name}),
rk{name} AS (SELECT {by}, CAST(sum(pos + neg) AS BIGINT) AS n, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN {AUC} END AS auc, sum(pos * tp / k) / nullif(sum(pos), 0) AS ap FROM qw{name} GROUP BY {by})"""


@query("d17_bootstrap_auc", boot("user_id", "user_id") + " SELECT user_id, round(auc_mean, 6) AS auc_mean, round(auc_std, 6) AS auc_std, valid FROM bs")
def d17(spark, d):
    b = M.bootstrap_auc(X.preds(spark, d), ["user_id"])
    return b.select("user_id", r6("auc_mean").alias("auc_mean"), r6("auc_std").alias("auc_std"), "valid")


@query("d18_bootstrap_thresholds", boot("split", "split") + """, k AS (SELECT unnest(range(0, 101)) AS k),
cf AS (SELECT split, iteration, k, coalesce(sum(pos) FILTER (WHERE y_score >= k / 100.0::DOUBLE), 0) AS tp, sum(pos) AS p, coalesce(sum(neg) FILTER (WHERE y_score < k / 100.0::DOUBLE), 0) AS tn, sum(neg) AS n FROM hs, k GROUP BY ALL),
m AS (SELECT split, k, coalesce(tp / nullif(p, 0), 0) AS sens, coalesce(tn / nullif(n, 0), 0) AS spec, (tp + tn) / (p + n) AS acc FROM cf),
r AS (SELECT split, k, round(avg(sens), 6) AS sensitivity_mean, round(stddev_samp(sens), 6) AS sensitivity_std, round(avg(spec), 6) AS specificity_mean, round(stddev_samp(spec), 6) AS specificity_std, round(avg(acc), 6) AS accuracy_mean, round(stddev_samp(acc), 6) AS accuracy_std FROM m GROUP BY split, k)
SELECT r.*, round(auc_mean, 6) AS auc_mean, round(auc_std, 6) AS auc_std FROM r JOIN bs ON bs.split = r.split""")
def d18(spark, d):
    b = M.bootstrap_thresholds(X.preds(spark, d), ["split"])
    return b.select("split", "k", *[r6(f"{n}_{s}").alias(f"{n}_{s}") for n in (*M.THRESHOLD_METRICS, "auc") for s in ("mean", "std")])


@query("d19_pooled_auc", boot("split", "split") + " SELECT split, round(auc_mean, 6) AS auc_mean, round(auc_std, 6) AS auc_std FROM bs")
def d19(spark, d):
    return M.bootstrap_auc(X.preds(spark, d), ["split"]).select("split", r6("auc_mean").alias("auc_mean"), r6("auc_std").alias("auc_std"))


@query("d20_pooled_per_round", boot("round, split", "round || ':' || split") + ", fp AS (SELECT 'full' AS split, y_true, y_score FROM preds WHERE split = 'test')" + boot("split", "split", "fp", name="f") + """,
pg AS (SELECT user_id, round, CAST(count(*) FILTER (WHERE split = 'val') AS DOUBLE) AS num_labeled, CAST(count(*) AS DOUBLE) AS total FROM preds GROUP BY ALL),
c AS (SELECT round, avg(num_labeled) AS num_labeled, avg(total) AS total, avg(100 * num_labeled / total) AS pct FROM pg GROUP BY round), ft AS (SELECT sum(total) AS total FROM (SELECT user_id, arg_min(total, round) AS total FROM pg GROUP BY user_id))
SELECT c.round, split, round(num_labeled, 6) AS num_labeled, round(total, 6) AS total, round(pct, 6) AS pct, round(auc_mean, 6) AS auc_mean, round(auc_std, 6) AS auc_std FROM c LEFT JOIN bs ON c.round = bs.round UNION ALL SELECT NULL, split, ft.total, ft.total, 100, round(auc_mean, 6), round(auc_std, 6) FROM bsf, ft""")
def d20(spark, d):
    p = X.preds(spark, d)
    progress = p.groupBy("user_id", "round").agg(F.sum((F.col("split") == "val").cast("double")).alias("num_labeled"), F.count(F.lit(1)).cast("double").alias("total"))
    return M.pooled_auc_per_round(progress, p, p.where("split = 'test'")).select("round", "split", *[r6(c).alias(c) for c in ("num_labeled", "total", "pct", "auc_mean", "auc_std")])


@query("d21_ensemble_grid", """, ab AS (SELECT split, y_true, unnest(range(0, 11)) AS alpha_k, y_score AS a, CAST(sample_id % 97 AS DOUBLE) / 97 AS b FROM preds),
mx AS (SELECT split, y_true, alpha_k, round(alpha_k / 10.0::DOUBLE * a + (1 - alpha_k / 10.0::DOUBLE) * b, 9) AS y_score FROM ab)""" + auc_sql("mx", "split, alpha_k") + " SELECT split, alpha_k, round(auc, 5) AS auc FROM au")
def d21(spark, d):
    p = X.preds(spark, d).select("split", "y_true", F.col("y_score").alias("a"), ((F.col("sample_id") % 97).cast("double") / 97).alias("b"))
    return M.ensemble_weight_grid(p, "a", "b", ["split"]).select("split", "alpha_k", F.round("auc", 5).alias("auc"))


MC = """, mc AS (SELECT sample_id, ps, CAST('0x' || substr(md5('7:' || sample_id || ':' || ps), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS prob FROM preds, (SELECT unnest(range(0, 5)) AS ps)),
st AS (SELECT sample_id, avg(prob) AS m, stddev_pop(prob) AS s, var_pop(prob) AS v, avg(-(prob * ln(prob + 1e-8) + (1 - prob) * ln(1 - prob + 1e-8))) AS ee FROM mc GROUP BY sample_id),
be AS (SELECT *, -(m * ln(m + 1e-8) + (1 - m) * ln(1 - m + 1e-8)) AS pe FROM st)"""


def mc(spark, d):
    p = X.preds(spark, d).select("sample_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("pass"))
    return p.withColumn("prob", hash_unit(7, "sample_id", "pass"))


@query("d22_mc_stats", MC + " SELECT sample_id, round(m, 6) AS mean, round(s, 6) AS std, round(pe, 6) AS predictive_entropy, round(ee, 6) AS expected_entropy, round(pe - ee, 6) AS bald FROM be")
def d22(spark, d):
    return M.mc_stats(mc(spark, d)).select("sample_id", *[r6(c).alias(c) for c in ("mean", "std", "predictive_entropy", "expected_entropy", "bald")])


@query("d23_ensemble_variance", MC + " SELECT round(avg(v), 6) AS mean_var, round(median(v), 6) AS median_var, round(avg(s), 6) AS mean_std FROM be")
def d23(spark, d):
    return M.ensemble_variance(mc(spark, d))[1].select(*[r6(c).alias(c) for c in ("mean_var", "median_var", "mean_std")])


@query("d23_sample_variance", MC + " SELECT sample_id, round(m, 6) AS mean, round(v, 6) AS var, round(s, 6) AS std FROM be")
def d23_samples(spark, d):
    return M.ensemble_variance(mc(spark, d))[0].select("sample_id", *[r6(c).alias(c) for c in ("mean", "var", "std")])


@query("f1_margin_topk", " SELECT sample_id, round(1 - abs(2 * y_score - 1), 6) AS uncertainty FROM preds ORDER BY round(1 - abs(2 * y_score - 1), 6) DESC, sample_id LIMIT 100")
def f1(spark, d):
    from ..operators.active import margin_topk

    return margin_topk(X.preds(spark, d), 100).select("sample_id", "uncertainty")


@query("f2_std_topk", MC + " SELECT sample_id, round(s, 6) AS std FROM be ORDER BY round(s, 9) DESC, sample_id LIMIT 100")
def f2(spark, d):
    from ..operators.active import topk

    return topk(M.mc_stats(mc(spark, d)), "std", "sample_id", 100).select("sample_id", r6("std").alias("std"))


@query("f2_bald_topk", MC + " SELECT sample_id, round(pe - ee, 6) AS bald FROM be ORDER BY round(pe - ee, 9) DESC, sample_id LIMIT 100")
def f2b(spark, d):
    from ..operators.active import topk

    return topk(M.mc_stats(mc(spark, d)), "bald", "sample_id", 100).select("sample_id", r6("bald").alias("bald"))


@query("f3_ensemble_topk", MC + " SELECT sample_id, round(v, 6) AS var FROM be ORDER BY round(v, 9) DESC, sample_id LIMIT 100")
def f3(spark, d):
    from ..operators.active import topk

    return topk(M.mc_stats(mc(spark, d)), "var", "sample_id", 100).select("sample_id", r6("var").alias("var"))


@query("f4_top_fraction", " , u AS (SELECT sample_id, round(1 - abs(2 * y_score - 1), 6) AS u FROM preds) SELECT sample_id, u AS uncertainty FROM (SELECT *, row_number() OVER (ORDER BY u DESC, sample_id) AS rk, count(*) OVER () AS n FROM u) WHERE rk <= greatest(50, ceil(0.02 * n))")
def f4(spark, d):
    from ..operators.active import margin_score, top_fraction

    return top_fraction(margin_score(X.preds(spark, d)), "uncertainty", "sample_id", 0.02, 50).select("sample_id", "uncertainty")
