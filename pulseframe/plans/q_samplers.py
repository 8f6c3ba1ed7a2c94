"""Queries of day splits, samplers and balancing."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from ..operators import active as A
from ..operators import balance as B
from ..operators import clean as C
from ..operators import splits as S
from ..operators import temporal as T
from ..registry import query
from .q_temporal import CANDIDATES, WINDOWS

DAY = C.DAY
ROWS = f""", rows AS (SELECT user_id, reading_id, t // {DAY} AS day, CAST(systolic > 130 OR diastolic > 80 AS BIGINT) AS state_val FROM readings)"""
DAYS = ROWS + """, dy AS (SELECT user_id, day, count(*) AS n, CAST(sum(state_val) AS BIGINT) AS pos FROM rows GROUP BY ALL),
dr AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY md5('42:' || user_id || ':' || day), day) AS rk, count(*) OVER (PARTITION BY user_id) AS nd FROM dy)"""
HASH = "md5('42:' || {k}), {k}"


def rows(spark, d):
    r = C.spike_label(X.readings(spark, d))
    return r.select("user_id", "reading_id", C.day("t").alias("day"), F.col("BP_spike").alias("state_val"))


def days(spark, d):
    return rows(spark, d).groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("n"), F.sum("state_val").alias("pos"))


RETRY = f""", tr AS (SELECT dr.*, i, CAST(ceil(round(s * nd, 9)) AS BIGINT) AS te FROM dr, (SELECT unnest(range(0, 10)) AS i, unnest({list(S.TEST_SIZES)}::DOUBLE[]) AS s)),
vl AS (SELECT *, nd - te AS rest, CAST(ceil(0.25::DOUBLE * (nd - te)) AS BIGINT) AS vn, rk > te AS inn FROM tr),
cl AS (SELECT *, count(*) OVER (PARTITION BY user_id, i, inn, n) AS sz, row_number() OVER (PARTITION BY user_id, i, inn, n ORDER BY rk) AS pl FROM vl),
cs AS (SELECT user_id, i, n, any_value(sz) AS sz, any_value(vn) AS vn, any_value(rest) AS rest, any_value(vn * sz) // any_value(rest) AS fl, any_value(vn * sz) % any_value(rest) AS lf FROM cl WHERE inn GROUP BY user_id, i, n),
ct AS (SELECT *, row_number() OVER (PARTITION BY user_id, i ORDER BY lf DESC, n) AS turn, vn - sum(fl) OVER (PARTITION BY user_id, i) AS extra,
  min(sz) OVER (PARTITION BY user_id, i) >= 2 AND vn >= count(*) OVER (PARTITION BY user_id, i) AND rest - vn >= count(*) OVER (PARTITION BY user_id, i) AS can FROM cs),
sp AS (SELECT cl.*, CASE WHEN NOT inn THEN 'test' WHEN CASE WHEN can THEN pl <= fl + CASE WHEN turn <= extra THEN 1 ELSE 0 END ELSE rk <= te + cl.vn END THEN 'val' ELSE 'train' END AS split
  FROM cl LEFT JOIN ct ON ct.user_id = cl.user_id AND ct.i = cl.i AND ct.n = cl.n),
ok AS (SELECT user_id, i FROM sp GROUP BY ALL HAVING sum(CASE WHEN split = 'test' THEN n ELSE 0 END) >= 2 AND sum(CASE WHEN split = 'test' THEN pos ELSE 0 END) >= 2 AND sum(CASE WHEN split = 'test' THEN n - pos ELSE 0 END) >= 2 AND sum(CASE WHEN split = 'val' THEN n ELSE 0 END) >= 2),
ds AS (SELECT sp.user_id, day, split FROM sp JOIN (SELECT user_id, min(i) AS i FROM ok GROUP BY user_id) o ON o.user_id = sp.user_id AND o.i = sp.i)"""


@query("i1_day_split_retry", DAYS + RETRY + " SELECT user_id, day, split FROM ds")
def i1(spark, d):
    return S.day_split_retry(days(spark, d))


@query("i2_count_day_split", DAYS + """ SELECT user_id, day, CASE WHEN coalesce(sum(n) OVER (PARTITION BY user_id ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 0.25 * sum(n) OVER (PARTITION BY user_id) THEN 'test' ELSE 'train' END AS split FROM dr""")
def i2(spark, d):
    return S.sample_count_day_split(days(spark, d))


@query("i1_skipped_users", DAYS + RETRY + """ SELECT user_id, count(*) AS days, CAST(sum(n) AS BIGINT) AS windows, CAST(sum(pos) AS BIGINT) AS positives,
CASE WHEN sum(n) < 4 THEN 'too few windows' WHEN least(sum(pos), sum(n) - sum(pos)) < 2 THEN 'too few of a class' ELSE 'no size fits' END AS reason
FROM dy WHERE user_id NOT IN (SELECT user_id FROM ds) GROUP BY user_id UNION ALL SELECT -1, count(DISTINCT user_id), 0, 0, 'split' FROM ds""")
def i1_skipped(spark, d):
    """The report, and how many users have a split."""
    per_day = days(spark, d)
    split = S.day_split_retry(per_day)
    zero = F.lit(0).cast("long")
    done = split.select(F.countDistinct("user_id").alias("days")).select(F.lit(-1).cast("long").alias("user_id"), "days", zero.alias("windows"), zero.alias("positives"), F.lit("split").alias("reason"))
    return S.skipped_users(per_day, split).unionByName(done)


def quota_sql(frac: str, by: str, source: str = "rows", within: str = "") -> str:
    """qt: by, n, quota by largest remainders; rh: the source's rows with r, their place in hash order of reading_id."""
    over = f"(PARTITION BY {within})" if within else "()"
    return f""", sz AS (SELECT {by}, count(*) AS n, round({frac}::DOUBLE * count(*), 9) AS share FROM {source} GROUP BY {by}),
qt AS (SELECT {by}, n, CAST(floor(share) AS BIGINT) + CASE WHEN row_number() OVER ({'PARTITION BY ' + within if within else ''} ORDER BY round(share - floor(share), 9) DESC, {by}) <= floor(round({frac}::DOUBLE * sum(n) OVER {over}, 9) + 0.5) - sum(floor(share)) OVER {over} THEN 1 ELSE 0 END AS quota FROM sz),
rh AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY md5('42:' || reading_id), reading_id) AS r FROM {source})"""


@query("i3_stratified_split", ROWS + quota_sql("0.3", "user_id, state_val") + " SELECT reading_id, r <= quota AS chosen FROM rh JOIN qt USING (user_id, state_val)")
def i3(spark, d):
    return S.stratified_split(rows(spark, d), 0.3, ["user_id", "state_val"], 42, "reading_id").select("reading_id", "chosen")


@query("i3_split_per_user", ROWS + quota_sql("0.35", "user_id, state_val", within="user_id") + " SELECT user_id, state_val, count(*) AS n, count(*) FILTER (WHERE r <= quota) AS chosen FROM rh JOIN qt USING (user_id, state_val) GROUP BY ALL")
def i3_per_user(spark, d):
    """Each user's total is exact."""
    s = S.stratified_split(rows(spark, d), 0.35, ["user_id", "state_val"], 42, "reading_id", within=["user_id"])
    return s.groupBy("user_id", "state_val").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("chosen").cast("long")).alias("chosen"))


@query("i4_safe_sample", ROWS + quota_sql("0.1", "state_val") + " SELECT reading_id FROM rh JOIN qt USING (state_val) WHERE r <= quota")
def i4(spark, d):
    return S.safe_sample(rows(spark, d), 0.1, "state_val", 42, "reading_id").select("reading_id")


@query("i5_stratified_min", ROWS + """ SELECT reading_id, row_number() OVER (PARTITION BY state_val ORDER BY md5('42:' || reading_id), reading_id) <= greatest(0, least(floor(count(*) OVER (PARTITION BY state_val) * 0.9), count(*) OVER (PARTITION BY state_val) - 5)) AS hidden FROM rows""")
def i5(spark, d):
    return S.stratified_split_min(rows(spark, d), 0.9, "state_val", 42, "reading_id").select("reading_id", "hidden")


@query("i6_target_quota", ROWS + """, n AS (SELECT greatest(4, CAST(round_even((1 - 0.9::DOUBLE) * count(*), 0) AS BIGINT)) AS want FROM rows),
own AS (SELECT reading_id FROM (SELECT *, row_number() OVER (PARTITION BY state_val ORDER BY md5('42:' || reading_id), reading_id) AS r FROM rows WHERE user_id = 3) WHERE r = 1),
lf AS (SELECT want - (SELECT count(*) FROM own) AS lft FROM n),
ot AS (SELECT *, row_number() OVER (PARTITION BY state_val ORDER BY md5('42:' || reading_id), reading_id) AS r, count(*) OVER (PARTITION BY state_val) AS m, count(*) OVER () AS tot FROM rows WHERE user_id <> 3),
pk AS (SELECT reading_id FROM ot, lf WHERE r <= greatest(1, CAST(round_even(CAST(lft AS DOUBLE) * m / tot, 0) AS BIGINT)) ORDER BY r, md5('42:' || reading_id), reading_id LIMIT (SELECT lft FROM lf))
SELECT reading_id FROM own UNION ALL SELECT reading_id FROM pk""")
def i6(spark, d):
    return S.target_quota_split(rows(spark, d), 3, 0.9, 42, "reading_id").select("reading_id")


@query("i7_min_per_user", ROWS + """, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY md5('42:' || reading_id), reading_id) AS k FROM rows),
q AS (SELECT *, row_number() OVER (ORDER BY greatest(k - 2, 0), md5('42:' || user_id), user_id) AS o, count(*) FILTER (WHERE k <= 2) OVER () AS base, count(*) OVER () AS n FROM r)
SELECT reading_id FROM q WHERE k <= 2 OR o <= greatest(base, ceil(0.2 * n))""")
def i7(spark, d):
    return S.min_per_user_split(rows(spark, d), 0.2, 42, "reading_id").select("reading_id")


@query("i8_day_class_seed", ROWS + """, h AS (SELECT *, md5('42:' || reading_id) AS h FROM rows), w AS (SELECT greatest(1, CAST(floor((1 - 0.5::DOUBLE) * count(*)) AS BIGINT)) AS want FROM rows),
dd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY h, reading_id) AS r FROM h) WHERE r = 1),
lf AS (SELECT want - (SELECT count(*) FROM dd) AS lft FROM w),
mo AS (SELECT reading_id FROM (SELECT *, row_number() OVER (PARTITION BY state_val ORDER BY h, reading_id) AS r FROM h ANTI JOIN dd USING (reading_id)), lf WHERE r <= CASE WHEN state_val = 1 THEN lft // 2 ELSE lft - lft // 2 END),
fi AS (SELECT reading_id FROM dd UNION ALL SELECT reading_id FROM mo),
al AS (SELECT h.reading_id, row_number() OVER (ORDER BY f.reading_id IS NULL, h, h.reading_id) AS o FROM h LEFT JOIN fi f ON f.reading_id = h.reading_id)
SELECT reading_id FROM al, w WHERE o <= want""")
def i8(spark, d):
    return S.day_class_seed(rows(spark, d), 0.5, 42, "reading_id").select("reading_id")


@query("i9_variance_seed", """, s AS (SELECT vec_id, md5('42:' || vec_id) AS h, list_stddev_pop(z[1:30]) + list_stddev_pop(z[31:60]) AS score FROM pool),
e AS (SELECT quantile_cont(score, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM s), b AS (SELECT s.*, len(list_filter(list_distinct(e), lambda x: x < score)) AS bin FROM s, e),
o AS (SELECT vec_id, h, row_number() OVER (PARTITION BY bin ORDER BY h, vec_id) AS r FROM b), q AS (SELECT vec_id, row_number() OVER (ORDER BY r <> 1, h, vec_id) AS k, count(*) OVER () AS n FROM o)
SELECT vec_id FROM q WHERE k <= floor((1 - 0.9::DOUBLE) * n)""")
def i9(spark, d):
    p = X.pool(spark, d).select("vec_id", (C.seq_std(F.slice("z", 1, 30)) + C.seq_std(F.slice("z", 31, 30))).alias("score"))
    return S.variance_seed(p, "score", 0.9, 42, "vec_id").select("vec_id")


@query("i10_day_balanced_seed", ROWS + """, p AS (SELECT user_id, day, arg_min(reading_id, md5('42:' || reading_id)) FILTER (WHERE state_val = 1) AS p, arg_min(reading_id, md5('42:' || reading_id)) FILTER (WHERE state_val = 0) AS n FROM rows GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day) AS k FROM p),
g AS (WITH RECURSIVE f AS (SELECT user_id, k, CASE WHEN p IS NOT NULL THEN p ELSE n END AS reading_id, CAST(p IS NOT NULL AS BIGINT) AS np, CAST(p IS NULL AS BIGINT) AS nn FROM o WHERE k = 1
UNION ALL SELECT o.user_id, o.k, CASE WHEN p IS NOT NULL AND (np <= nn OR n IS NULL) THEN p ELSE n END, np + CAST(p IS NOT NULL AND (np <= nn OR n IS NULL) AS BIGINT), nn + CAST(NOT (p IS NOT NULL AND (np <= nn OR n IS NULL)) AS BIGINT) FROM f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1) SELECT * FROM f)
SELECT user_id, reading_id FROM g""")
def i10(spark, d):
    return S.day_balanced_seed(rows(spark, d), 42, "reading_id")


@query("i11_undersample", ROWS + """, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY md5('42:' || reading_id), reading_id) AS r FROM rows WHERE state_val = 1),
o AS (SELECT reading_id, row_number() OVER (ORDER BY r, user_id) AS k FROM n), c AS (SELECT count(*) FILTER (WHERE state_val = 1) - count(*) FILTER (WHERE state_val = 0) AS x FROM rows)
SELECT reading_id FROM rows WHERE reading_id NOT IN (SELECT reading_id FROM o, c WHERE k <= x)""")
def i11(spark, d):
    flipped = rows(spark, d).withColumn("state_val", 1 - F.col("state_val"))  # spikes are the larger class here
    return B.undersample_negatives(flipped, 42, "reading_id").select("reading_id")


@query("i12_oversample_counts", ROWS + """, f AS (SELECT user_id, reading_id, 1 - state_val AS state_val FROM rows), c AS (SELECT count(*) FILTER (WHERE state_val = 0) - count(*) FILTER (WHERE state_val = 1) AS w FROM f),
u AS (SELECT user_id, count(*) AS own, row_number() OVER (ORDER BY user_id) AS r, count(*) OVER () AS n FROM f WHERE state_val = 1 GROUP BY user_id)
SELECT user_id, own, CAST(w // n + CASE WHEN r <= w % n THEN 1 ELSE 0 END AS BIGINT) AS extra FROM u, c""")
def i12(spark, d):
    flipped = rows(spark, d).withColumn("state_val", 1 - F.col("state_val"))
    o = B.oversample_positives(flipped, 42, "reading_id").where("state_val = 1")
    return o.groupBy("user_id").agg(F.sum((F.col("copy") == 0).cast("long")).alias("own"), F.sum((F.col("copy") > 0).cast("long")).alias("extra"))


@query("i13_oversample_capped", ROWS + """, f AS (SELECT user_id, reading_id FROM rows WHERE state_val = 0), c AS (SELECT CAST(ceil(1.0 * (SELECT count(*) FROM rows WHERE state_val = 1)) AS BIGINT) - (SELECT count(*) FROM f) AS want),
u AS (SELECT user_id, count(*) AS own, CAST(count(*) * 1 AS BIGINT) AS most FROM f GROUP BY user_id), s AS (SELECT u.user_id, own, most, want, unnest(range(1, most + 1)) AS turn FROM u, c),
k AS (SELECT *, row_number() OVER (ORDER BY turn, user_id) AS o FROM s)
SELECT user_id, own, CAST(count(*) FILTER (WHERE o <= want) AS BIGINT) AS extra FROM k GROUP BY user_id, own""")
def i13(spark, d):
    o = B.oversample_minority_capped(rows(spark, d), 42, "reading_id", cap=2).where("state_val = 0")
    return o.groupBy("user_id").agg(F.sum((F.col("copy") == 0).cast("long")).alias("own"), F.sum((F.col("copy") > 0).cast("long")).alias("extra"))


@query("i15_split_80_20", ROWS + """ SELECT reading_id, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY md5('42:' || reading_id), reading_id) <= floor(0.8 * count(*) OVER (PARTITION BY user_id)) THEN 'train' ELSE 'val' END AS split FROM rows""")
def i15(spark, d):
    return S.split_rows_80_20(rows(spark, d), 42, "reading_id").select("reading_id", "split")


@query("i16_slice_plan", """, c AS (SELECT user_id, label % 2 AS state_val, count(*) AS n FROM (SELECT vec_id % 16 AS user_id, label FROM embeddings WHERE vec_id < 100000) GROUP BY ALL), t AS (SELECT state_val, sum(n) AS n FROM c GROUP BY state_val)
SELECT CAST(state_val AS BIGINT) AS state_val, CAST(greatest(round_even(3000 * CASE WHEN state_val = 1 THEN 0.43::DOUBLE ELSE 1 - 0.43::DOUBLE END / n, 0) - 1, 0) AS BIGINT) AS extra FROM t""".replace(" WHERE vec_id < 100000", ""))
def i16(spark, d):
    e = X.read(spark, d, "embeddings").select((F.col("label") % 2).cast("long").alias("state_val"))
    return B.slice_plan(e, 3000, 0.43)


@query("f5_random_k", " SELECT reading_id FROM readings ORDER BY md5('44:' || reading_id), reading_id LIMIT 100")
def f5(spark, d):
    return A.random_k(X.readings(spark, d), 100, 44, "reading_id").select("reading_id")


@query("f6_k_per_day", ROWS + " SELECT reading_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY md5('43:' || reading_id), reading_id) AS r FROM rows) WHERE r <= 2")
def f6(spark, d):
    return A.k_per_day(rows(spark, d), 2, 43, "reading_id").select("reading_id")


@query("c9_unlabeled_pool", " SELECT vec_id FROM pool WHERE NOT labeled")
def c9(spark, d):
    p = X.pool(spark, d)
    return A.unlabeled_pool(p, p.where("labeled"), "vec_id").select("vec_id")


@query("g3_date_overlap", f""" SELECT DISTINCT user_id, t // {DAY} AS day FROM readings WHERE reading_id % 2 = 0 INTERSECT SELECT DISTINCT user_id, t // {DAY} FROM readings WHERE reading_id % 2 = 1""")
def g3(spark, d):
    r = rows(spark, d)
    return S.date_overlap(r.where("reading_id % 2 = 0"), r.where("reading_id % 2 = 1"))


@query("k3_random_rounds", """, o AS (SELECT reading_id, row_number() OVER (ORDER BY md5('42:' || reading_id), reading_id) AS r FROM readings) SELECT CAST(ceil(r / 50.0) AS BIGINT) AS round, count(*) AS new, CAST(sum(count(*)) OVER (ORDER BY CAST(ceil(r / 50.0) AS BIGINT)) AS BIGINT) AS num_labeled FROM o WHERE r <= 1000 GROUP BY 1""")
def k3(spark, d):
    picked = A.random_rounds(X.readings(spark, d), 50, 20, 42, "reading_id")
    return A.round_log(picked, 0, 1).select("round", "new", F.col("num_labeled").cast("long").alias("num_labeled"))


@query("k3_uncertainty_rounds", """, u AS (SELECT sample_id, max(round(1 - abs(2 * y_score - 1), 6)) AS u FROM preds GROUP BY sample_id), o AS (SELECT sample_id, row_number() OVER (ORDER BY u DESC, sample_id) AS r FROM u) SELECT sample_id, CAST(ceil(r / 50.0) AS BIGINT) AS round FROM o WHERE r <= 1000""")
def k3u(spark, d):
    p = A.margin_score(X.preds(spark, d)).groupBy("sample_id").agg(F.max("uncertainty").alias("uncertainty"))
    return A.score_rounds(p, "uncertainty", 50, 20, "sample_id")


#: The window job's chain: complete users, spikes and quiet minutes as labels, windows, counts by day, splits of days.
BUILD = CANDIDATES.rstrip().removesuffix(",") + f""", ck AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY md5('42:' || user_id || ':' || minute), user_id, minute) AS rk FROM cd),
cn AS (SELECT user_id, count(*) FILTER (WHERE systolic > 130 OR diastolic > 80) - count(*) FILTER (WHERE NOT (systolic > 130 OR diastolic > 80)) AS n FROM readings GROUP BY user_id),
ku AS (SELECT user_id FROM readings INTERSECT SELECT user_id FROM signals WHERE data_type = 'hr' INTERSECT SELECT user_id FROM signals WHERE data_type = 'steps'),
lb AS (SELECT user_id, t, CAST(systolic > 130 OR diastolic > 80 AS BIGINT) AS state_val, 'r' || reading_id AS label_id FROM readings WHERE user_id IN (SELECT user_id FROM ku)
UNION ALL SELECT ck.user_id, minute * {T.MINUTE}, 0, 'n:' || ck.user_id || ':' || minute FROM ck JOIN cn ON cn.user_id = ck.user_id WHERE rk <= n AND ck.user_id IN (SELECT user_id FROM ku)), """ + WINDOWS[WINDOWS.index("p AS (") :].replace("FROM readings r", "FROM lb r").replace("reading_id", "label_id") + f""",
wl AS (SELECT lb.*, t // {DAY} AS day FROM lb JOIN w USING (label_id)), dy AS (SELECT user_id, day, count(*) AS n, CAST(sum(state_val) AS BIGINT) AS pos FROM wl GROUP BY ALL),
dr AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY md5('42:' || user_id || ':' || day), day) AS rk, count(*) OVER (PARTITION BY user_id) AS nd FROM dy)""" + RETRY.replace("sp AS (", "sl AS (").replace("FROM sp ", "FROM sl sp ")


@query("k1_build_windows", BUILD + " SELECT wl.user_id, label_id, state_val, split FROM wl JOIN ds ON ds.user_id = wl.user_id AND ds.day = wl.day")
def k1(spark, d):
    from .jobs import build_windows

    return build_windows(X.readings(spark, d), X.signals(spark, d)).select("user_id", "label_id", "state_val", "split")


@query("k1_written_splits", BUILD + """, wr AS (SELECT wl.user_id, label_id, state_val, split FROM wl JOIN ds ON ds.user_id = wl.user_id AND ds.day = wl.day),
fp AS (SELECT user_id, split, count(*) AS rows, sha256(string_agg(line, chr(10) ORDER BY line)) AS sha256 FROM (SELECT user_id, split, user_id || '|' || label_id || '|' || state_val AS line FROM wr) GROUP BY user_id, split)
SELECT user_id, split, fp.rows, sha256, pos FROM fp JOIN (SELECT user_id, split, CAST(sum(state_val) AS BIGINT) AS pos FROM wr GROUP BY user_id, split) USING (user_id, split)""")
def k1_written(spark, d):
    """The window job's files, read back, beside the fingerprints that were written with them."""
    from ..sources.paths import scratch
    from .jobs import write_windows

    out = scratch(spark, "windows-by-split")
    prints = write_windows(X.readings(spark, d), X.signals(spark, d), out)
    back = spark.read.parquet(f"{out}/windows").groupBy("user_id", "split").agg(F.sum("state_val").alias("pos"))
    return prints.join(back, ["user_id", "split"]).select("user_id", "split", "rows", "sha256", "pos")
