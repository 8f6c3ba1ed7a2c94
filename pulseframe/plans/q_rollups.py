"""Queries of roll-ups, set operations and tables of results."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from ..hashing import WHOLE, with_position
from ..operators import clean as C
from ..operators import rollups as R
from ..registry import query, r6
from ..sources import writers
from ..sources.paths import scratch
from .q_temporal import WINDOWS, windows

DAY = C.DAY
RUNS = """, runs AS (SELECT l_suppkey AS seed, l_returnflag AS method, CAST(l_linenumber AS BIGINT) AS round, avg(l_discount) * 5 AS auc, avg(l_tax) AS auc_sd FROM lineitem GROUP BY ALL)"""
METHODS = ["A", "N", "R"]


def runs(spark, d, seed="l_suppkey"):
    x = X.read(spark, d, "lineitem")
    return x.groupBy(F.col(seed).alias("seed"), F.col("l_returnflag").alias("method"), F.col("l_linenumber").cast("long").alias("round")).agg((F.avg("l_discount") * 5).alias("auc"), F.avg("l_tax").alias("auc_sd"))


def split_rows(spark, d):
    r = C.spike_label(X.readings(spark, d)).withColumnRenamed("BP_spike", "state_val")
    pick = F.col("reading_id") % 10
    return r.withColumn("split", F.when(pick < 2, "test").when(pick < 4, "val").otherwise("train"))


SPLIT = """, sr AS (SELECT *, CAST(systolic > 130 OR diastolic > 80 AS BIGINT) AS state_val, CASE WHEN reading_id % 10 < 2 THEN 'test' WHEN reading_id % 10 < 4 THEN 'val' ELSE 'train' END AS split FROM readings)"""


ZSCORED = "list_transform({0}, lambda x: (x - list_avg({0})) / CASE WHEN list_stddev_pop({0}) > 1e-12 THEN list_stddev_pop({0}) ELSE 1 END)"
STATS = ("hr_mean", "hr_std", "st_mean", "st_std")


@query("d2_user_signal_stats", WINDOWS + f""", m AS (SELECT user_id, list_avg({ZSCORED.format("hr")}) AS hr, list_avg({ZSCORED.format("st")}) AS st FROM w JOIN readings USING (reading_id))
SELECT user_id, count(*) AS n, round(avg(hr), 6) + 0.0 AS hr_mean, round(stddev_samp(hr), 6) + 0.0 AS hr_std, round(avg(st), 6) + 0.0 AS st_mean, round(stddev_samp(st), 6) + 0.0 AS st_std FROM m GROUP BY user_id""")
def d2(spark, d):
    w = windows(spark, d)
    s = R.user_signal_stats(w)
    return w.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).join(s, "user_id").select("user_id", "n", *[(r6(c) + 0.0).alias(c) for c in STATS])


@query("d2_pool_signal_stats", """, m AS (SELECT user_id, list_avg(z[1:30]) AS hr, list_avg(z[31:60]) AS st FROM pool) SELECT user_id, round(avg(hr), 6) AS hr_mean, round(stddev_samp(hr), 6) AS hr_std, round(avg(st), 6) AS st_mean, round(stddev_samp(st), 6) AS st_std FROM m GROUP BY user_id""")
def d2p(spark, d):
    p = X.pool(spark, d).select("user_id", F.slice("z", 1, 30).alias("hr_seq"), F.slice("z", 31, 30).alias("st_seq"))
    return R.user_signal_stats(p).select("user_id", *[r6(c).alias(c) for c in ("hr_mean", "hr_std", "st_mean", "st_std")])


@query("d3_class_counts", SPLIT + " SELECT user_id, " + ", ".join(f"count(*) FILTER (WHERE split = '{s}') AS {s}_len, count(*) FILTER (WHERE split = '{s}' AND state_val = 1) AS {s}_pos, count(*) FILTER (WHERE split = '{s}' AND state_val = 0) AS {s}_neg" for s in ("train", "val", "test")) + " FROM sr GROUP BY user_id")
def d3(spark, d):
    return R.class_counts(split_rows(spark, d))


@query("d4_label_alignment", SPLIT + """, k AS (SELECT * FROM sr WHERE user_id % 5 <> 0 OR split = 'train')
SELECT user_id, split, raw, coalesce(kept, 0) AS kept FROM (SELECT user_id, split, count(*) AS raw FROM sr GROUP BY ALL) LEFT JOIN (SELECT user_id, split, count(*) AS kept FROM k GROUP BY ALL) USING (user_id, split)""")
def d4(spark, d):
    r = split_rows(spark, d)
    return R.label_alignment(r, r.where("user_id % 5 <> 0 OR split = 'train'"))


@query("d6_split_summary", SPLIT + """, b AS (SELECT user_id, state_val, 0 AS s FROM sr UNION ALL SELECT user_id, state_val, 1 FROM sr WHERE reading_id % 4 <> 1)
SELECT user_id, op AS orig_pos, o - op AS orig_neg, np AS new_pos, n - np AS new_neg, greatest(n - o, 0) AS added, greatest(o - n, 0) AS removed FROM (
SELECT user_id, count(*) FILTER (WHERE s = 0) AS o, count(*) FILTER (WHERE s = 0 AND state_val = 1) AS op, count(*) FILTER (WHERE s = 1) AS n, count(*) FILTER (WHERE s = 1 AND state_val = 1) AS np FROM b GROUP BY ROLLUP (user_id))""")
def d6(spark, d):
    r = split_rows(spark, d)
    return R.split_summary(r, r.where("reading_id % 4 <> 1"))


@query("c11_merge_round_metrics", RUNS + """, c AS (SELECT round, count(*) AS n FROM runs GROUP BY round), p AS (SELECT round, round(avg(auc), 6) AS auc FROM runs WHERE round < 5 GROUP BY round) SELECT c.round, n, auc FROM c LEFT JOIN p ON c.round = p.round""")
def c11(spark, d):
    r = runs(spark, d)
    return R.merge_round_metrics(r.groupBy("round").agg(F.count(F.lit(1)).alias("n")), r.where("round < 5").groupBy("round").agg(r6(F.avg("auc")).alias("auc")))


@query("c12_shared_seeds", RUNS.replace("l_suppkey", "l_orderkey") + " SELECT seed, method, round FROM runs WHERE seed IN (SELECT seed FROM runs GROUP BY seed HAVING count(DISTINCT method) = (SELECT count(DISTINCT method) FROM runs))")
def c12(spark, d):
    # an order as a seed: many lack a method
    return R.shared_seed_runs(runs(spark, d, "l_orderkey"), "seed", "method").select("seed", "method", "round")


@query("d24_mean_std_per_round", RUNS + " SELECT method, round, round(avg(auc), 6) AS auc_mean, round(stddev_samp(auc), 6) AS auc_std, round(avg(auc) + avg(auc_sd), 6) AS upper FROM runs GROUP BY method, round")
def d24(spark, d):
    return R.mean_std_per_round(runs(spark, d)).select("method", "round", *[r6(c).alias(c) for c in ("auc_mean", "auc_std", "upper")])


@query("d25_final_round", RUNS + ", l AS (SELECT seed, method, arg_max(auc, round) AS auc FROM runs GROUP BY seed, method) SELECT method, round(avg(auc), 6) AS auc_mean, round(stddev_samp(auc), 6) AS auc_std, count(*) AS n FROM l GROUP BY method")
def d25(spark, d):
    return R.final_round_summary(runs(spark, d)).select("method", r6("auc_mean").alias("auc_mean"), r6("auc_std").alias("auc_std"), "n")


USERS = list(range(16))
QUERIED = """, q AS (SELECT user_id, 1 + event_id % 12 AS round FROM self_reports)"""


def queried(spark, d):
    return X.self_reports(spark, d).select("user_id", (1 + F.col("event_id") % 12).alias("round"))


@query("d26_queried_counts", QUERIED + " SELECT round, " + ", ".join(f"count(*) FILTER (WHERE user_id = {u}) AS u{u}" for u in USERS) + " FROM q GROUP BY round")
def d26(spark, d):
    return R.queried_counts(queried(spark, d), USERS)


@query("d27_binned_counts", QUERIED + ", b AS (SELECT user_id, (round - 1) // 3 AS bin, count(*) AS total FROM q GROUP BY ALL) SELECT user_id, bin, total, CAST(sum(total) OVER (PARTITION BY user_id ORDER BY bin) AS BIGINT) AS running FROM b")
def d27(spark, d):
    return R.binned_cumulative_counts(queried(spark, d).groupBy("user_id", "round").agg(F.count(F.lit(1)).alias("n")), 3)


@query("d28_pivot_runs", RUNS + ", w AS (SELECT CAST(seed AS VARCHAR) AS run, " + ", ".join(f"avg(auc) FILTER (WHERE method = '{m}') AS {m}" for m in METHODS) + " FROM runs GROUP BY seed) SELECT run, " + ", ".join(f"round({m}, 6) AS {m}" for m in METHODS) + " FROM w UNION ALL SELECT 'mean', " + ", ".join(f"round(avg({m}), 6)" for m in METHODS) + " FROM w UNION ALL SELECT 'std', " + ", ".join(f"round(stddev_samp({m}), 6)" for m in METHODS) + " FROM w")
def d28(spark, d):
    p = R.pivot_runs(runs(spark, d), "seed", "method", "auc", METHODS)
    return p.select("run", *[r6(m).alias(m) for m in METHODS])


@query("d29_unpivot_metrics", " SELECT c_custkey, 'a' AS pipeline, c_acctbal AS value FROM customer UNION ALL SELECT c_custkey, 'b', CAST(c_nationkey AS DOUBLE) FROM customer WHERE c_custkey % 3 <> 0")
def d29(spark, d):
    c = X.read(spark, d, "customer")
    wide = c.select("c_custkey", F.col("c_acctbal").cast("string").alias("a_AUC_Train"), F.when(F.col("c_custkey") % 3 == 0, "n/a").otherwise(F.col("c_nationkey").cast("string")).alias("b_AUC_Train"), "c_name")
    return R.unpivot_metrics(wide, "c_custkey", "_AUC_Train")


#: Results by user, pipeline, substance and task: a train auc in some files only, the test auc as a number or as text.
SUMMARIES = """, su AS (SELECT 'hp' || o_custkey % 20 AS uid, CAST(substr(o_orderpriority, 1, 1) AS VARCHAR) AS pipeline, o_orderstatus AS substance, CASE WHEN o_custkey % 2 = 0 THEN 'Use' ELSE 'Crave' END AS task, o_orderkey AS path,
CASE WHEN o_orderkey % 3 = 0 THEN round(o_totalprice / 2000000, 4) END AS train, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN round(o_totalprice / 1000000, 4) END, round(o_totalprice / 1000000, 3)) AS mean, 0.01::DOUBLE AS std FROM orders),
pp AS (SELECT CAST(substr(o_orderpriority, 1, 1) AS VARCHAR) AS pipeline, o_orderstatus AS substance, CASE WHEN o_custkey % 2 = 0 THEN 'Use' ELSE 'Crave' END AS task, CAST(l_returnflag = 'R' AS BIGINT) AS y_true, round(l_discount * 5 + l_tax * 5, 4) AS y_score FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"""
PIPES = ["1", "2", "3"]
CELLS = ("train", "mean", "std")


def _keys(orders):
    task = F.when(F.col("o_custkey") % 2 == 0, "Use").otherwise("Crave")
    return [F.substring("o_orderpriority", 1, 1).alias("pipeline"), F.col("o_orderstatus").alias("substance"), task.alias("task")]


def summaries(spark, d):
    o = X.read(spark, d, "orders")
    price = F.col("o_totalprice") / 1_000_000
    return o.select(
        F.concat(F.lit("hp"), (F.col("o_custkey") % 20).cast("string")).alias("uid"), *_keys(o), F.col("o_orderkey").alias("path"), F.when(F.col("o_orderkey") % 3 == 0, F.round(price / 2, 4)).alias("auc_train"),
        F.when(F.col("o_orderkey") % 2 == 0, F.round(price, 4)).alias("auc_mean"), F.lit(None).cast("double").alias("auc_std"), F.concat(F.round(price, 3).cast("string"), F.lit(" ± 0.01")).alias("auc_text"),
    )


def predictions(spark, d):
    o = X.read(spark, d, "orders").join(X.read(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return o.select(*_keys(o), (F.col("l_returnflag") == "R").cast("long").alias("y_true"), F.round(F.col("l_discount") * 5 + F.col("l_tax") * 5, 4).alias("y_score"))


def wide_sql(by: str, source: str = "su") -> str:
    """A row for each user, first values by path, and the row of all users' predictions, resampled."""
    from .q_metrics import boot

    lead, keys = (by + ", " if by else ""), (by + ", " if by else "") + "pipeline"
    first = ", ".join(f"arg_min({c}, path) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in CELLS)
    texts = " || ':' || ".join(keys.split(", "))
    cells = ", ".join(f"round(max({c}) FILTER (WHERE pipeline = '{p}'), 6) AS {c}{p}" for p in PIPES for c in CELLS)
    tail = f""", ce AS (SELECT {keys}, uid, {first} FROM {source} GROUP BY {keys}, uid), al AS (SELECT {keys}, uid, train, mean, std FROM ce UNION ALL SELECT {keys}, 'AGGREGATED', NULL, auc_mean, auc_std FROM bs)
SELECT {lead}uid, {cells} FROM al GROUP BY {lead}uid"""
    return boot(keys, texts, "pp") + tail


def wide_columns(wide, by):
    return wide.select(*by, "uid", *[r6(f"{p}_{c}").alias(f"{c}{p}") for p in PIPES for c in CELLS])


@query("d30_auc_wide", SUMMARIES + wide_sql(""))
def d30(spark, d):
    return wide_columns(R.auc_wide_table(summaries(spark, d), predictions(spark, d), PIPES), [])


@query("d31_grouped_tables", SUMMARIES + wide_sql("substance, task"))
def d31(spark, d):
    return wide_columns(R.auc_wide_table(summaries(spark, d), predictions(spark, d), PIPES, ["substance", "task"]), ["substance", "task"])


@query("d32_feature_correlation", """ SELECT a, b, round(c, 6) AS corr FROM (SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, corr(l_quantity, l_extendedprice) AS c FROM lineitem UNION ALL SELECT 'l_quantity', 'l_tax', corr(l_quantity, l_tax) FROM lineitem UNION ALL SELECT 'l_quantity', 'twice', corr(l_quantity, l_quantity * 2 + 1) FROM lineitem
UNION ALL SELECT 'l_extendedprice', 'l_tax', corr(l_extendedprice, l_tax) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'twice', corr(l_extendedprice, l_quantity * 2 + 1) FROM lineitem UNION ALL SELECT 'l_tax', 'twice', corr(l_tax, l_quantity * 2 + 1) FROM lineitem) WHERE abs(c) > 0.5""")
def d32(spark, d):
    x = X.read(spark, d, "lineitem").withColumn("twice", F.col("l_quantity") * 2 + 1)
    return R.feature_correlation(x, ["l_quantity", "l_extendedprice", "l_tax", "twice"], 0.5).withColumn("corr", r6("corr"))


@query("d33_split_fingerprint", SPLIT + " SELECT user_id, split, count(*) AS rows, sha256(string_agg(line, chr(10) ORDER BY line)) AS sha256 FROM (SELECT user_id, split, user_id || '|' || t || '|' || state_val AS line FROM sr) GROUP BY user_id, split")
def d33(spark, d):
    return R.split_fingerprint(split_rows(spark, d), ["user_id", "split"], F.concat_ws("|", "user_id", "t", "state_val"))


@query("d33_group_fingerprint", SPLIT + ", f AS (SELECT split, count(*) AS n, sha256(string_agg(line, chr(10) ORDER BY line)) AS h FROM (SELECT user_id, split, user_id || '|' || t || '|' || state_val AS line FROM sr) GROUP BY user_id, split) SELECT split, CAST(sum(n) AS BIGINT) AS rows, sha256(string_agg(h, chr(10) ORDER BY h)) AS sha256 FROM f GROUP BY split")
def d33g(spark, d):
    return R.fingerprint_of_groups(d33(spark, d), ["split"])


@query("d34_representation_means", " SELECT user_id, i - 1 AS pos, round(avg(z[i]), 6) AS mean FROM pool, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL")
def d34(spark, d):
    return R.representation_means(X.pool(spark, d), "user_id", "z").withColumn("mean", r6("mean"))


@query("d34_representation_plane")
def d34_plane(spark, d):
    return R.representation_plane(R.representation_means(X.pool(spark, d), "user_id", "z"), "user_id").select("user_id", r6("x").alias("x"), r6("y").alias("y"))


@query("g1_pos_neg_union", " SELECT reading_id, 1 AS val FROM readings WHERE systolic > 130 OR diastolic > 80 UNION ALL SELECT reading_id, 0 FROM readings WHERE NOT (systolic > 130 OR diastolic > 80)")
def g1(spark, d):
    r = C.spike_label(X.readings(spark, d))
    return r.where("BP_spike = 1").select("reading_id", F.lit(1).alias("val")).unionByName(r.where("BP_spike = 0").select("reading_id", F.lit(0).alias("val")))


@query("g2_pool_users", " SELECT user_id, t, systolic, NULL::BIGINT AS stress FROM readings UNION ALL SELECT user_id, t, NULL, stress FROM stress")
def g2(spark, d):
    return R.pool_users([X.readings(spark, d).select("user_id", "t", "systolic"), X.stress(spark, d).select("stress", "t", "user_id")])


@query("g4_labeled_except", " SELECT vec_id FROM pool WHERE labeled OR vec_id % 2 = 0")
def g4(spark, d):
    p = X.pool(spark, d)
    return p.select("vec_id").exceptAll(p.where("NOT labeled AND vec_id % 2 = 1").select("vec_id"))


@query("g6_upsert_results", " SELECT user_id, reading_id, NULL::BIGINT AS stress FROM readings WHERE user_id NOT IN (SELECT user_id FROM stress WHERE user_id < 5) UNION ALL SELECT user_id, NULL, stress FROM stress WHERE user_id < 5")
def g6(spark, d):
    return R.upsert_user_results(X.readings(spark, d).select("user_id", "reading_id"), X.stress(spark, d).where("user_id < 5").select("user_id", "stress"))


@query("g6_replace_users", """, a AS (SELECT user_id, count(*) AS n, CAST(sum(reading_id) AS BIGINT) AS total FROM readings GROUP BY user_id), b AS (SELECT user_id, count(*) AS n, CAST(sum(stress) AS BIGINT) AS total FROM stress WHERE user_id < 5 GROUP BY user_id)
SELECT user_id, n, total FROM b UNION ALL SELECT user_id, n, total FROM a WHERE user_id NOT IN (SELECT user_id FROM b)""")
def g6_replace(spark, d):
    """A stored aggregate by user; a second run of some users takes their place, and its rerun changes nothing."""
    out = scratch(spark, "users")
    old = X.readings(spark, d).select("user_id", F.col("reading_id").alias("value"))
    new = X.stress(spark, d).where("user_id < 5").select("user_id", F.lit("second").alias("run"), F.col("stress").alias("value"))
    for rows in (old, new, new):
        writers.replace_users(rows, out)
    return writers.read_users(spark, out).groupBy(F.col("user_id").cast("long").alias("user_id")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("f7_numeric_order", " SELECT uid, row_number() OVER (ORDER BY try_cast(regexp_replace(uid, '\\D', '', 'g') AS BIGINT) NULLS LAST, uid) AS pos FROM (SELECT DISTINCT CASE WHEN c_custkey % 7 = 0 THEN 'none' ELSE 'hp' || c_custkey END AS uid FROM customer)")
def f7(spark, d):
    u = X.read(spark, d, "customer").select(F.when(F.col("c_custkey") % 7 == 0, "none").otherwise(F.concat(F.lit("hp"), F.col("c_custkey").cast("string"))).alias("uid")).distinct()
    # the positions are the query's, to make the order visible; the operator itself sorts
    number = F.coalesce(R.numeric_id(F.col("uid")), F.lit(1 << 62))
    return with_position(R.sort_by_numeric_id(u, "uid"), [], F.floor(number / 1000), [number, F.col("uid")], "pos").select("uid", "pos")


@query("a7_latest_per_key", " SELECT o_custkey % 20 AS uid, o_orderstatus AS task, arg_max(o_orderkey, struct_pack(a := o_orderdate, b := o_orderkey)) AS path FROM orders GROUP BY ALL")
def a7(spark, d):
    o = X.read(spark, d, "orders").select((F.col("o_custkey") % 20).alias("uid"), F.col("o_orderstatus").alias("task"), F.col("o_orderkey").alias("path"), F.col("o_orderdate").alias("mtime"))
    return R.latest_per_key(o, ["uid", "task"])


@query("a8_prediction_pairs", """, p AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY sample_id, y_score, y_true) AS pos, y_score FROM preds), l AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY sample_id, y_score, y_true) AS pos, y_true FROM preds WHERE user_id % 9 <> 4 OR sample_id % 3 = 0)
SELECT p.user_id, p.pos, y_score, y_true FROM p JOIN l ON p.user_id = l.user_id AND p.pos = l.pos WHERE p.user_id IN (SELECT a.user_id FROM (SELECT user_id, count(*) AS n FROM p GROUP BY user_id) a JOIN (SELECT user_id, count(*) AS n FROM l GROUP BY user_id) b USING (user_id, n))""")
def a8(spark, d):
    p = X.preds(spark, d)
    at = lambda rows: with_position(rows, ["user_id"], F.floor(F.col("sample_id") / WHOLE), ["sample_id", "y_score", "y_true"], "pos")
    labels = p.where("user_id % 9 <> 4 OR sample_id % 3 = 0")
    return R.aligned_pairs(at(p).select("user_id", "pos", "y_score"), at(labels).select("user_id", "pos", "y_true"))
