"""Queries of cleaning, labelling and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from ..functions import scalars as S
from ..operators import clean as C
from ..registry import query, r6

DAY = C.DAY


@query("a2_self_reports", """SELECT event_id, user_id, t, substance FROM self_reports WHERE scenario = 'Use' AND substance = 'melon'""")
def a2(spark, d):
    return C.filter_self_reports(X.self_reports(spark, d), "melon", "Use").select("event_id", "user_id", "t", "substance")


@query("a3_clean_readings", """SELECT reading_id, systolic, diastolic FROM (
  SELECT reading_id, CASE WHEN reading_id % 7 = 0 THEN -2147483648 ELSE systolic END AS systolic, diastolic FROM readings) WHERE systolic <> -2147483648""")
def a3(spark, d):
    r = X.readings(spark, d).withColumn("systolic", F.when(F.col("reading_id") % 7 == 0, C.SENTINEL).otherwise(F.col("systolic")))
    return C.clean_bp_readings(r, ("systolic", "diastolic")).select("reading_id", F.col("systolic").cast("long").alias("systolic"), "diastolic")


@query("b1_spike_label", """SELECT reading_id, CAST(CASE WHEN systolic > 130 OR diastolic > 80 THEN 1 ELSE 0 END AS BIGINT) AS BP_spike FROM readings""")
def b1(spark, d):
    return C.spike_label(X.readings(spark, d)).select("reading_id", "BP_spike")


@query("b2_select_modality", """SELECT user_id, t, value FROM signals WHERE data_type = 'hr' AND value IS NOT NULL""")
def b2(spark, d):
    return C.select_modality(X.signals(spark, d), "hr").select("user_id", "t", "value")


@query("b3_drop_first_day", f""", f AS (SELECT user_id, min(t // {DAY}) AS d0 FROM (SELECT user_id, t FROM readings UNION ALL SELECT user_id, t FROM signals WHERE data_type = 'hr') GROUP BY user_id)
SELECT reading_id, user_id, t FROM readings JOIN f USING (user_id) WHERE t // {DAY} > d0""")
def b3(spark, d):
    return C.drop_first_day(X.readings(spark, d), C.select_modality(X.signals(spark, d), "hr")).select("reading_id", "user_id", "t")


@query("b7_impute_features", """, tr AS (SELECT l_linenumber, l_orderkey, CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_quantity END AS q, CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE l_tax END AS x FROM lineitem),
m AS (SELECT quantile_cont(q, 0.5) AS mq, quantile_cont(x, 0.5) AS mx FROM tr WHERE l_linenumber <= 3)
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, coalesce(q, mq, 0) AS q, coalesce(x, mx, 0) AS x FROM tr, m WHERE l_linenumber > 3""")
def b7(spark, d):
    rows = X.read(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.when(F.col("l_orderkey") % 5 != 0, F.col("l_quantity")).alias("q"), F.when(F.col("l_partkey") % 3 != 0, F.col("l_tax")).alias("x"))
    return C.impute_features(rows.where("l_linenumber <= 3"), rows.where("l_linenumber > 3"), ["q", "x"])


@query("b8_scale_features", """, s AS (SELECT avg(systolic) AS a, stddev_pop(systolic) AS sd, avg(diastolic) AS a2, stddev_pop(diastolic) AS sd2 FROM readings WHERE reading_id % 3 <> 0)
SELECT reading_id, round((systolic - a) / sd, 6) AS systolic, round((diastolic - a2) / sd2, 6) AS diastolic FROM readings, s WHERE reading_id % 3 = 0""")
def b8(spark, d):
    r = X.readings(spark, d).select("reading_id", "systolic", "diastolic")
    z = C.scale_features(r.where("reading_id % 3 <> 0"), r.where("reading_id % 3 = 0"), ["systolic", "diastolic"])
    return z.select("reading_id", r6("systolic").alias("systolic"), r6("diastolic").alias("diastolic"))


@query("b9_complete_users", """SELECT user_id FROM (SELECT user_id, data_type FROM signals UNION ALL SELECT user_id, 'readings' FROM readings) GROUP BY user_id HAVING count(DISTINCT data_type) = 3""")
def b9(spark, d):
    return C.complete_users(X.signals(spark, d), X.readings(spark, d))


@query("b10_small_splits", """SELECT user_id, split, count(*) AS total, CAST(sum(y_true) AS BIGINT) AS pos, CAST(count(*) - sum(y_true) AS BIGINT) AS neg FROM preds
GROUP BY user_id, split HAVING count(*) < 300 OR least(sum(y_true), count(*) - sum(y_true)) < 100""")
def b10(spark, d):
    return C.small_split_report(X.preds(spark, d).withColumnRenamed("y_true", "state_val"), 300, 100)


@query("b11_time_cutoff_split", f"""SELECT reading_id, CASE WHEN t < min(t) OVER (PARTITION BY user_id) + 20 * {DAY} THEN 'train' ELSE 'test' END AS split FROM readings""")
def b11(spark, d):
    return C.time_cutoff_split(X.readings(spark, d)).select("reading_id", "split")


@query("b12_day_split", f""", dd AS (SELECT DISTINCT user_id, t // {DAY} AS day FROM readings),
r AS (SELECT user_id, day, row_number() OVER (PARTITION BY user_id ORDER BY day) AS rk, count(*) OVER (PARTITION BY user_id) AS n FROM dd)
SELECT reading_id, CASE WHEN rk <= floor(n * 0.75) THEN 'train' ELSE 'test' END AS split FROM readings JOIN r ON r.user_id = readings.user_id AND r.day = t // {DAY}""")
def b12(spark, d):
    return C.chronological_day_split(X.readings(spark, d)).select("reading_id", "split")


@query("b14_hide_labels", """SELECT vec_id, CAST(-1 AS BIGINT) AS state_val, state_val AS true_label FROM pool""")
def b14(spark, d):
    return C.hide_labels(X.pool(spark, d)).select("vec_id", "state_val", "true_label")


@query("c10_cohort_filter", """SELECT reading_id, user_id FROM readings WHERE user_id IN (SELECT user_id FROM self_reports WHERE substance = 'melon' AND scenario = 'Use')""")
def c10(spark, d):
    return C.cohort_filter(X.readings(spark, d), X.self_reports(spark, d), "melon", "Use").select("reading_id", "user_id")


@query("d1_dedupe_timestamps", """SELECT user_id, data_type, t // 60000000 AS t, round(avg(value), 6) AS value FROM signals GROUP BY user_id, data_type, t // 60000000""")
def d1(spark, d):
    s = X.signals(spark, d).withColumn("t", F.floor(F.col("t") / 60_000_000).cast("long"))
    return C.dedupe_timestamps(s).withColumn("value", r6("value"))


@query("d35_distinct_days", f"""SELECT DISTINCT user_id, t // {DAY} AS day FROM readings""")
def d35(spark, d):
    return X.readings(spark, d).select("user_id", C.day("t").alias("day")).distinct()


@query("h1_cut_fraction_ts", """SELECT event_id, epoch_us(date_trunc('second', ts)) AS t FROM events""")
def h1(spark, d):
    return X.read(spark, d, "events").select("event_id", X.micros(S.cut_fraction_ts(F.concat(F.col("ts").cast("string"), F.lit("-10:00")))).alias("t"))


@query("h2_calendar_features", """SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week, CAST(hour(ts) BETWEEN 9 AND 17 AS INTEGER) AS is_working_hours, CAST(isodow(ts) >= 6 AS INTEGER) AS is_weekend FROM events""")
def h2(spark, d):
    return X.read(spark, d, "events").select("event_id", *[c.cast("int").alias(n) for n, c in S.calendar_features(F.col("ts")).items()])


@query("h3_interactions", """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, round(l_quantity / (l_partkey + 1), 6) AS hr_steps_ratio, round(l_quantity * l_tax, 6) AS stress_weighted_hr,
round(l_tax / (l_partkey + 1), 6) AS stress_steps_ratio, round(l_discount / (l_tax + 1e-5), 6) AS steps_hr_variability FROM lineitem""")
def h3(spark, d):
    x = X.read(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.col("l_quantity").alias("hr_mean"), F.col("l_partkey").alias("steps_total"), F.col("l_tax").alias("stress_mean"), F.col("l_discount").alias("steps_std"), F.col("l_tax").alias("hr_std"))
    return x.select("l_orderkey", "l_linenumber", *[r6(c).alias(n) for n, c in S.interaction_features().items()])


@query("h4_participant_id", """SELECT c_custkey, regexp_extract('data/hp' || c_custkey || '/hp' || c_custkey || '_hr.csv', '(\\d+)', 1) AS uid FROM customer""")
def h4(spark, d):
    k = F.col("c_custkey").cast("string")
    return X.read(spark, d, "customer").select("c_custkey", S.participant_id(F.concat(F.lit("data/hp"), k, F.lit("/hp"), k, F.lit("_hr.csv"))).alias("uid"))


@query("h5_mean_std_text", """SELECT o_custkey, printf('%.3f ± %.3f', m, s) AS text, CAST(printf('%.3f', m) AS DOUBLE) AS mean, CAST(printf('%.3f', s) AS DOUBLE) AS std FROM (
SELECT o_custkey, CAST(count(*) AS DOUBLE) / 8 AS m, CAST(count(*) AS DOUBLE) / 4 AS s FROM orders GROUP BY o_custkey)""")
def h5(spark, d):
    n = X.read(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).cast("double").alias("n"))
    text = n.select("o_custkey", S.format_mean_std(F.col("n") / 8, F.col("n") / 4).alias("text"))
    mean, std = S.parse_mean_std(F.col("text"))
    return text.select("o_custkey", "text", mean.alias("mean"), std.alias("std"))


@query("h6_hp_folder", """SELECT p_partkey, 'UF' || (p_size % 9 + 1) * 10 || '_K' || p_size || '_B19' || CASE WHEN p_size % 2 = 0 THEN '_T50' ELSE '' END || '_DR50' AS folder,
CAST((p_size % 9 + 1) * 10 AS DOUBLE) AS UF, CAST(p_size AS DOUBLE) AS K, CASE WHEN p_size % 2 = 0 THEN 50.0 END AS T FROM part""")
def h6(spark, d):
    size = F.col("p_size")
    p = X.read(spark, d, "part").select("p_partkey", S.hp_folder((size % 9 + 1) * 10, size, F.lit(19), F.when(size % 2 == 0, 50), F.lit(50)).alias("folder"))
    parsed = S.parse_hp_folder(F.col("folder"))
    return p.select("p_partkey", "folder", *[parsed[k].alias(k) for k in ("UF", "K", "T")])


@query("h7_budget", """SELECT o_custkey, CAST(greatest(1, ceil(0.9 * count(*) / 3)) AS BIGINT) AS budget FROM orders GROUP BY o_custkey""")
def h7(spark, d):
    n = X.read(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return n.select("o_custkey", S.budget(F.lit(0.9).cast("double"), F.col("n"), F.lit(3)).alias("budget"))


@query("h8_sequence_stats", """SELECT vec_id, round(list_avg(z), 6) AS mean, round(list_stddev_pop(z), 6) AS std, round((z[1] - list_avg(z)) / list_stddev_pop(z), 6) AS z1 FROM pool""")
def h8(spark, d):
    z = F.col("z")
    return X.pool(spark, d).select("vec_id", r6(C.seq_mean(z)).alias("mean"), r6(C.seq_std(z)).alias("std"), r6(S.zscore_seq(z)[0]).alias("z1"))


@query("h9_stack_channels", """SELECT vec_id, unnest(range(1, 31)) AS pos, unnest(list_transform(range(1, 31), lambda i: round(z[i], 6))) AS a, unnest(list_transform(range(1, 31), lambda i: round(z[i + 30], 6))) AS b FROM pool""")
def h9(spark, d):
    x = X.pool(spark, d).select("vec_id", F.posexplode(S.stack_channels(F.slice("z", 1, 30), F.slice("z", 31, 30))))
    return x.select("vec_id", (F.col("pos") + 1).cast("long").alias("pos"), r6(F.col("col")[0]).alias("a"), r6(F.col("col")[1]).alias("b"))


@query("h10_l2_normalize", """SELECT vec_id, round(z[1] / (sqrt(list_dot_product(z, z)) + 1e-8), 6) AS z1, round(z[64] / (sqrt(list_dot_product(z, z)) + 1e-8), 6) AS z64 FROM pool""")
def h10(spark, d):
    n = X.pool(spark, d).select("vec_id", S.l2_normalize(F.col("z")).alias("u"))
    return n.select("vec_id", r6(F.col("u")[0]).alias("z1"), r6(F.col("u")[63]).alias("z64"))


@query("h11_parse_packed", """SELECT event_id, CAST(event_id % 50 AS DOUBLE) AS deep, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS rem, CAST(event_id % 7 AS DOUBLE) AS efficiency FROM events""")
def h11(spark, d):
    e = F.col("event_id")
    text = F.concat(F.lit("Deep: "), (e % 50).cast("string"), F.lit(", efficiency: 1, rem: "), F.when(e % 3 == 0, "-1").otherwise(F.col("value").cast("string")), F.lit(", start_time: 2024-02-16T01:49:30.000, efficiency: "), (e % 7).cast("string"))
    m = X.read(spark, d, "events").select("event_id", S.parse_packed(text).alias("m"))
    return m.select("event_id", S.missing_as_null(F.col("m")["Deep"]).alias("deep"), S.missing_as_null(F.col("m")["rem"]).alias("rem"), S.missing_as_null(F.col("m")["efficiency"]).alias("efficiency"))


@query("h12_split_task", """SELECT event_id, substance, 'BP_' || scenario AS task FROM self_reports""")
def h12(spark, d):
    a, b = S.split_task(F.concat(F.col("substance"), F.lit("_BP_"), F.col("scenario")))
    return X.self_reports(spark, d).select("event_id", a.alias("substance"), b.alias("task"))


@query("h14_logistic_score", """, w AS (SELECT z AS w FROM pool WHERE vec_id = 0) SELECT vec_id, round(1 / (1 + exp(-(list_dot_product(z, w) + 0.1))), 6) AS p FROM pool, w""")
def h14(spark, d):
    p = X.pool(spark, d)
    w = F.broadcast(p.where("vec_id = 0").select(F.col("z").alias("w")))  # one row
    return p.crossJoin(w).select("vec_id", r6(S.logistic_score(F.col("z"), F.col("w"), 0.1)).alias("p"))


@query("g5_ordered_dedupe", """ SELECT reading_id, CASE WHEN user_id % 7 = user_id % 3 THEN CAST(user_id % 7 AS VARCHAR) ELSE user_id % 7 || ',' || user_id % 3 END || CASE WHEN 90 + reading_id % 2 IN (user_id % 7, user_id % 3) THEN '' ELSE ',' || (90 + reading_id % 2) END AS tokens FROM readings""")
def g5(spark, d):
    a, b, c = ((F.col("user_id") % 7).cast("string"), (F.col("user_id") % 3).cast("string"), (90 + F.col("reading_id") % 2).cast("string"))
    text = F.concat_ws(",", a, F.concat(F.lit(" "), b), a, c, F.lit(""), F.concat(b, F.lit(" ")))
    return X.readings(spark, d).select("reading_id", F.array_join(S.ordered_dedupe(text), ",").alias("tokens"))


@query("b4_feature_columns", """, f AS (SELECT reading_id, systolic * 1.0::DOUBLE AS hr_mean, diastolic * 1.0::DOUBLE AS steps_total FROM readings) SELECT reading_id, hr_mean, steps_total FROM f""")
def b4(spark, d):
    """A feature table cut down to what a model may see: no ids, targets, stress columns or long windows."""
    r = X.readings(spark, d)
    wide = r.select("*", *[(F.col(c) * 1.0).alias(n) for n, c in (("hr_mean", "systolic"), ("hr_mean_10min", "systolic"), ("hr_std_60min", "diastolic"), ("stress_mean", "diastolic"), ("steps_total", "diastolic"))])
    return wide.select("reading_id", *C.feature_columns(wide.columns, ("user_id", "reading_id", "t", "systolic", "diastolic"), ("stress", "10min", "30min", "60min")))


