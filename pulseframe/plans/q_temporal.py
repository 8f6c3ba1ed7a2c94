"""Queries of joins in time, grids, windows and rolling features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import fixtures as X
from ..functions.scalars import interaction_features
from ..operators import clean as C
from ..operators import temporal as T
from ..operators import windows as N
from ..registry import query, r6

M, H, DAY = T.MINUTE, T.HOUR, C.DAY

HR_STEPS = """, hs AS (SELECT h.user_id, h.t, h.value AS hr, s.value AS steps, s.t AS steps_t FROM (SELECT * FROM signals WHERE data_type = 'hr') h
ASOF LEFT JOIN (SELECT * FROM signals WHERE data_type = 'steps') s ON h.user_id = s.user_id AND h.t >= s.t)"""


def hr_steps(spark, d) -> DataFrame:
    s = X.signals(spark, d)
    hr = C.select_modality(s, "hr").select("user_id", "t", F.col("value").alias("hr"))
    st = C.select_modality(s, "steps").withColumn("steps_t", F.col("t"))
    return T.asof_backward(hr, st, ["user_id"], {"steps": "value", "steps_t": "steps_t"})


@query("c1_asof_backward", HR_STEPS + " SELECT user_id, t, hr, steps, steps_t FROM hs")
def c1(spark, d):
    return hr_steps(spark, d)


GRID = f""", b AS (SELECT user_id, data_type, min(t) AS mn, max(t) AS mx FROM signals GROUP BY ALL),
g AS (SELECT user_id, data_type, unnest(range(mn, mx + 1, {M})) AS t FROM b)"""


@query("c3_minute_grid", GRID + """, v AS (SELECT g.user_id, g.data_type, g.t, s.value FROM g ASOF JOIN signals s ON g.user_id = s.user_id AND g.data_type = s.data_type AND g.t >= s.t)
SELECT user_id, data_type, t // 3600000000 AS hour, count(*) AS n, round(sum(value), 4) AS total FROM v GROUP BY ALL""")
def c3(spark, d):
    g = T.minute_grid_ffill(X.signals(spark, d))
    return g.groupBy("user_id", "data_type", F.floor(F.col("t") / H).cast("long").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("c4_interval_join", f"""SELECT reading_id, round(avg(stress), 6) AS stress_mean, CAST(min(stress) AS DOUBLE) AS stress_min, CAST(max(stress) AS DOUBLE) AS stress_max, round(stddev_samp(stress), 6) AS stress_std
FROM readings r LEFT JOIN stress s ON r.user_id = s.user_id AND abs(r.t - s.t) <= {15 * M} GROUP BY reading_id""")
def c4(spark, d):
    j = T.interval_join_agg(X.readings(spark, d), X.stress(spark, d), "reading_id", "stress")
    return j.select("reading_id", r6("stress_mean").alias("stress_mean"), "stress_min", "stress_max", r6("stress_std").alias("stress_std"))


WINDOWS = f""", b AS (SELECT user_id, data_type, min(t) AS mn, max(t) AS mx FROM signals GROUP BY ALL),
p AS (SELECT reading_id, r.user_id, data_type, unnest(range(greatest(CAST(ceil((t - {H} - mn) / {M}) AS BIGINT), 0), CAST(floor((least(t + {H}, mx) - mn) / {M}) AS BIGINT) + 1)) * {M} + mn AS g FROM readings r JOIN b USING (user_id)),
v AS (SELECT p.*, s.value FROM p ASOF JOIN signals s ON p.user_id = s.user_id AND p.data_type = s.data_type AND p.g >= s.t),
raw AS (SELECT reading_id, data_type FROM v GROUP BY ALL HAVING count(*) >= 30),
bins AS (SELECT reading_id, data_type, g // {4 * M} AS bin, avg(value) AS v FROM v GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY reading_id, data_type ORDER BY bin) AS k FROM bins JOIN raw USING (reading_id, data_type)),
seq AS (SELECT reading_id, data_type, list(v ORDER BY k) AS s FROM rk WHERE k <= 30 GROUP BY ALL HAVING count(*) = 30),
w AS (SELECT a.reading_id, a.s AS hr, c.s AS st FROM seq a JOIN seq c ON a.reading_id = c.reading_id AND a.data_type = 'hr' AND c.data_type = 'steps')"""


def windows(spark, d) -> DataFrame:
    return N.label_windows(C.spike_label(X.readings(spark, d)), X.signals(spark, d))


@query("c5_label_windows", WINDOWS + """ SELECT reading_id, round((hr[1] - list_avg(hr)) / CASE WHEN list_stddev_pop(hr) > 1e-12 THEN list_stddev_pop(hr) ELSE 1 END, 5) AS hr1,
round((st[30] - list_avg(st)) / CASE WHEN list_stddev_pop(st) > 1e-12 THEN list_stddev_pop(st) ELSE 1 END, 5) AS st30 FROM w""")
def c5(spark, d):
    return windows(spark, d).select("reading_id", F.round(F.col("hr_seq")[0], 5).alias("hr1"), F.round(F.col("st_seq")[29], 5).alias("st30"))


@query("c5_window_counts", WINDOWS + """ SELECT user_id, count(*) AS n, count(*) FILTER (WHERE systolic > 130 OR diastolic > 80) AS pos,
count(*) FILTER (WHERE list_stddev_pop(hr) > 1e-12 AND list_stddev_pop(st) > 1e-12) AS moving FROM w JOIN readings USING (reading_id) GROUP BY user_id""")
def c5_counts(spark, d):
    w = windows(spark, d)
    moving = F.exists("hr_seq", lambda x: x != 0) & F.exists("st_seq", lambda x: x != 0)
    return w.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("BP_spike").alias("pos"), F.sum(moving.cast("long")).alias("moving"))


@query("b5_drop_flatline", WINDOWS + """ SELECT reading_id FROM w WHERE list_stddev_pop(hr) > 1e-12 AND list_stddev_pop(st) > 1e-12""")
def b5(spark, d):
    return C.drop_flatline(windows(spark, d)).select("reading_id")


@query("b6_drop_all_zero", WINDOWS + """ SELECT reading_id FROM w WHERE list_stddev_pop(hr) > 1e-12""")
def b6(spark, d):
    return C.drop_all_zero(windows(spark, d)).select("reading_id")


ROUNDED = f"CAST(t // {M} + CASE WHEN t % {M} > {M // 2} OR (t % {M} = {M // 2} AND (t // {M}) % 2 = 1) THEN 1 ELSE 0 END AS BIGINT)"
SPIKES = """, sp AS (SELECT * FROM readings WHERE systolic > 130 OR diastolic > 80)"""
CANDIDATES = SPIKES + GRID + f""", gm AS (SELECT DISTINCT user_id, {ROUNDED} AS minute FROM g WHERE data_type = 'hr'),
nr AS (SELECT DISTINCT user_id, unnest(range(CAST(ceil((t - {H}) / {M}) AS BIGINT), CAST(floor((t + {H}) / {M}) AS BIGINT) + 1)) AS minute FROM sp),
cd AS (SELECT * FROM gm ANTI JOIN nr USING (user_id, minute)), """


def candidates(spark, d):
    r = C.spike_label(X.readings(spark, d))
    return r, T.negative_gaps(X.signals(spark, d), r.where("BP_spike = 1"))


@query("c6_negative_candidates", CANDIDATES + """k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY md5('42:' || user_id || ':' || minute), user_id, minute) AS rk FROM cd)
SELECT k.user_id, minute FROM k JOIN (SELECT user_id, count(*) AS n FROM sp GROUP BY user_id) USING (user_id) WHERE rk <= n""")
def c6(spark, d):
    r, found = candidates(spark, d)
    return T.sample_minutes(found, r.where("BP_spike = 1").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")), 42)


@query("c6_all_negatives", CANDIDATES + """k AS (SELECT user_id, minute // 1440 AS day, count(*) AS n, min(minute) AS first, max(minute) AS last, CAST(sum(minute) AS BIGINT) AS total FROM cd GROUP BY ALL) SELECT * FROM k""")
def c6_all(spark, d):
    """How many quiet minutes each day has, and which."""
    found = T.minutes_of(candidates(spark, d)[1]).groupBy("user_id", F.floor(F.col("minute") / 1440).alias("day"))
    return found.agg(F.count(F.lit(1)).alias("n"), F.min("minute").alias("first"), F.max("minute").alias("last"), F.sum("minute").alias("total"))


@query("c7_top_up_negatives", CANDIDATES + """k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY md5('42:' || user_id || ':' || minute), user_id, minute) AS rk FROM cd),
n AS (SELECT user_id, count(*) FILTER (WHERE systolic > 130 OR diastolic > 80) - count(*) FILTER (WHERE NOT (systolic > 130 OR diastolic > 80)) AS n FROM readings GROUP BY user_id)
SELECT k.user_id, minute FROM k JOIN n USING (user_id) WHERE rk <= n""")
def c7(spark, d):
    r, found = candidates(spark, d)
    return T.top_up_negatives(r.where("BP_spike = 1"), r.where("BP_spike = 0"), found)


@query("c8_rows_on_days", f"""SELECT reading_id FROM readings WHERE (user_id + t // {DAY}) % 4 = 0""")
def c8(spark, d):
    r = X.readings(spark, d)
    days = r.select("user_id", C.day("t").alias("day")).distinct().withColumn("split", F.when((F.col("user_id") + F.col("day")) % 4 == 0, "test").otherwise("train"))
    return T.rows_on_days(r, days, "test").select("reading_id")


ROLL_COLUMNS = [f"{s}_{n}_{m}min" for m in (5, 60) for s, n in (("hr", "mean"), ("hr", "std"), ("steps", "total"), ("steps", "diff"))]


@query("e1_rolling_time", HR_STEPS + " SELECT user_id, t, " + ", ".join(
    f"round(avg(hr) OVER w{m}, 5) AS hr_mean_{m}min, round(stddev_samp(hr) OVER w{m}, 5) AS hr_std_{m}min, round(sum(steps) OVER w{m}, 5) AS steps_total_{m}min, round(max(steps) OVER w{m} - min(steps) OVER w{m}, 5) AS steps_diff_{m}min" for m in (5, 60))
    + " FROM hs WINDOW " + ", ".join(f"w{m} AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN {m * M - 1} PRECEDING AND CURRENT ROW)" for m in (5, 60)))
def e1(spark, d):
    r = T.rolling_time_stats(hr_steps(spark, d), (5, 60))
    return r.select("user_id", "t", *[F.round(c, 5).alias(c) for c in ROLL_COLUMNS])


@query("c2_attach_features", HR_STEPS + f""", f AS (SELECT user_id, t, avg(hr) OVER w AS hr_mean, sum(steps) OVER w AS steps_total FROM hs WINDOW w AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN {10 * M - 1} PRECEDING AND CURRENT ROW))
SELECT reading_id, round(hr_mean, 5) AS hr_mean, round(steps_total, 5) AS steps_total FROM readings r ASOF LEFT JOIN f ON r.user_id = f.user_id AND r.t >= f.t""")
def c2(spark, d):
    f = T.rolling_time_stats(hr_steps(spark, d), (10,))
    j = T.asof_backward(X.readings(spark, d), f, ["user_id"], {"hr_mean": "hr_mean_10min", "steps_total": "steps_total_10min"})
    return j.select("reading_id", F.round("hr_mean", 5).alias("hr_mean"), F.round("steps_total", 5).alias("steps_total"))


@query("e2_rolling_rows", """SELECT reading_id, """ + ", ".join(f"CASE WHEN count(systolic) OVER w{n} = {n} THEN round(avg(systolic) OVER w{n}, 6) END AS mean{n}, CASE WHEN count(systolic) OVER w{n} = {n} THEN round(stddev_samp(systolic) OVER w{n}, 6) END AS std{n}, CASE WHEN count(systolic) OVER w{n} = {n} THEN CAST(sum(systolic) OVER w{n} AS BIGINT) END AS sum{n}" for n in (3, 5))
    + " FROM readings WINDOW " + ", ".join(f"w{n} AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (3, 5)))
def e2(spark, d):
    r = T.rolling_row_stats(X.readings(spark, d), "systolic")
    return r.select("reading_id", *[c for n in (3, 5) for c in (r6(f"systolic_roll{n}_mean").alias(f"mean{n}"), r6(f"systolic_roll{n}_std").alias(f"std{n}"), F.col(f"systolic_roll{n}_sum").alias(f"sum{n}"))])


@query("e3_lags", """SELECT reading_id, """ + ", ".join(f"lag({c}, {k}) OVER w AS {c}_lag_{k}" for c in ("systolic", "diastolic") for k in (1, 3, 5)) + " FROM readings WINDOW w AS (PARTITION BY user_id ORDER BY t)")
def e3(spark, d):
    return T.lag_features(X.readings(spark, d), ["systolic", "diastolic"]).drop("user_id", "t", "systolic", "diastolic")


@query("e4_minutes_since", f"""SELECT reading_id, round((t - lag(t) OVER (PARTITION BY user_id ORDER BY t)) / {M}, 6) AS minutes_since_previous FROM readings""")
def e4(spark, d):
    return T.minutes_since_previous(X.readings(spark, d)).select("reading_id", r6("minutes_since_previous").alias("minutes_since_previous"))


@query("e5_fill", """, x AS (SELECT reading_id, user_id, t, CASE WHEN reading_id % 3 = 0 THEN systolic END AS v FROM readings)
SELECT reading_id, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v FROM x""")
def e5(spark, d):
    x = X.readings(spark, d).withColumn("v", F.when(F.col("reading_id") % 3 == 0, F.col("systolic")))
    return T.ffill_bfill(x, ["v"]).select("reading_id", "v")


@query("e6_sliding_windows", """, z AS (SELECT user_id, (value - avg(value) OVER (PARTITION BY user_id)) / stddev_pop(value) OVER (PARTITION BY user_id) AS z, row_number() OVER (PARTITION BY user_id ORDER BY t) - 1 AS i FROM signals WHERE data_type = 'hr'),
n AS (SELECT user_id, count(*) AS n FROM z GROUP BY user_id), k AS (SELECT user_id, unnest(range(0, CASE WHEN n >= 30 THEN (n - 30) // 15 + 1 ELSE 0 END)) AS window_id FROM n)
SELECT k.user_id, window_id, round(sum(z), 5) AS total, round(sum(z * (i - window_id * 15)), 4) AS moment FROM k JOIN z ON z.user_id = k.user_id AND i >= window_id * 15 AND i < window_id * 15 + 30 GROUP BY ALL""")
def e6(spark, d):
    return moments(N.sliding_windows(C.select_modality(X.signals(spark, d), "hr")))


def moments(w):
    moment = F.aggregate(F.transform("seq", lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x)
    return w.select("user_id", "window_id", F.round(F.aggregate("seq", F.lit(0.0), lambda a, x: a + x), 5).alias("total"), F.round(moment, 4).alias("moment"))


@query("e6_train_day_windows", f""", tr AS (SELECT * FROM signals WHERE data_type = 'hr' AND (user_id + t // {DAY}) % 4 <> 0), z AS (SELECT user_id, (value - avg(value) OVER (PARTITION BY user_id)) / stddev_pop(value) OVER (PARTITION BY user_id) AS z, row_number() OVER (PARTITION BY user_id ORDER BY t) - 1 AS i FROM tr),
n AS (SELECT user_id, count(*) AS n FROM z GROUP BY user_id), k AS (SELECT user_id, unnest(range(0, CASE WHEN n >= 30 THEN (n - 30) // 15 + 1 ELSE 0 END)) AS window_id FROM n)
SELECT k.user_id, window_id, round(sum(z), 5) AS total, round(sum(z * (i - window_id * 15)), 4) AS moment FROM k JOIN z ON z.user_id = k.user_id AND i >= window_id * 15 AND i < window_id * 15 + 30 GROUP BY ALL""")
def e6_train(spark, d):
    """Windows over the samples of train days, scaled by them."""
    hr = C.select_modality(X.signals(spark, d), "hr")
    days = hr.select("user_id", F.floor(F.col("t") / DAY).alias("day")).distinct().where((F.col("user_id") + F.col("day")) % 4 != 0)
    return moments(N.sliding_windows(hr, train_days=days))


@query("e7_variance_bins", """, s AS (SELECT vec_id, list_stddev_pop(z[1:30]) + list_stddev_pop(z[31:60]) AS score FROM pool),
e AS (SELECT quantile_cont(score, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM s)
SELECT vec_id, CAST(len(list_filter(list_distinct(e), lambda x: x < score)) AS BIGINT) AS bin FROM s, e""")
def e7(spark, d):
    p = X.pool(spark, d).select("vec_id", (C.seq_std(F.slice("z", 1, 30)) + C.seq_std(F.slice("z", 31, 30))).alias("score"))
    return N.variance_bins(p, "score").select("vec_id", "bin")


@query("e9_labeled_days", f""", dd AS (SELECT DISTINCT user_id, t // {DAY} AS day FROM readings), sp AS (SELECT *, CASE WHEN (user_id + day) % 4 = 0 THEN 'test' ELSE 'train' END AS split FROM dd),
lb AS (SELECT DISTINCT user_id, t // {DAY} AS day FROM readings WHERE reading_id % 3 = 0)
SELECT user_id, day, split FROM sp WHERE split <> 'train' OR (user_id, day) IN (SELECT (user_id, day) FROM lb)""")
def e9(spark, d):
    from ..operators.splits import labeled_day_splits

    r = X.readings(spark, d)
    days = r.select("user_id", C.day("t").alias("day")).distinct().withColumn("split", F.when((F.col("user_id") + F.col("day")) % 4 == 0, "test").otherwise("train"))
    return labeled_day_splits(r.where("reading_id % 3 = 0"), days)


@query("k2_build_features", HR_STEPS + f""", f AS (SELECT user_id, t, avg(hr) OVER w AS hr_mean, stddev_samp(hr) OVER w AS hr_std, sum(steps) OVER w AS steps_total, stddev_samp(steps) OVER w AS steps_std FROM hs WINDOW w AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN {60 * M - 1} PRECEDING AND CURRENT ROW)),
d0 AS (SELECT user_id, min(t // {DAY}) AS d0 FROM (SELECT user_id, t FROM readings UNION ALL SELECT user_id, t FROM signals WHERE data_type = 'hr') GROUP BY user_id),
r AS (SELECT readings.* FROM readings JOIN d0 USING (user_id) WHERE t // {DAY} > d0),
a AS (SELECT r.*, hr_mean, hr_std, steps_total, steps_std FROM r ASOF LEFT JOIN f ON r.user_id = f.user_id AND r.t >= f.t),
s AS (SELECT reading_id, avg(stress) AS stress_mean FROM r LEFT JOIN stress s ON r.user_id = s.user_id AND abs(r.t - s.t) <= {15 * M} GROUP BY reading_id),
m AS (SELECT a.*, stress_mean, CASE WHEN systolic > 130 OR diastolic > 80 THEN 1 ELSE 0 END AS spike FROM a JOIN s USING (reading_id)),
l AS (SELECT *, CAST(lag(spike) OVER w AS BIGINT) AS spike_lag_1, coalesce(last_value(stress_mean IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(stress_mean IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS stress FROM m WINDOW w AS (PARTITION BY user_id ORDER BY t))
SELECT reading_id, CAST(spike AS BIGINT) AS BP_spike, spike_lag_1, round(hr_mean / (steps_total + 1), 5) AS hr_steps_ratio, round(hr_mean * stress, 5) AS stress_weighted_hr, round(steps_total, 5) AS steps_total FROM l""")
def k2(spark, d):
    from .jobs import build_features

    f = build_features(X.readings(spark, d), X.signals(spark, d), X.stress(spark, d))
    return f.select("reading_id", "BP_spike", F.col("BP_spike_lag_1").alias("spike_lag_1"), F.round("hr_steps_ratio", 5).alias("hr_steps_ratio"), F.round("stress_weighted_hr", 5).alias("stress_weighted_hr"), F.round("steps_total_60min", 5).alias("steps_total"))
