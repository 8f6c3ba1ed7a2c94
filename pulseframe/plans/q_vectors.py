"""Queries over the embedding pool."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from ..functions import augment as G
from ..functions.scalars import zscore_seq
from ..hashing import hash_unit
from ..operators import active as A
from ..operators import clean as C
from ..operators import splits as P
from ..operators import vectors as V
from ..registry import query, r6

LAB = """, u AS (SELECT * FROM pool WHERE NOT labeled), lb AS (SELECT * FROM pool WHERE labeled)"""


def both(spark, d):
    p = X.pool(spark, d)
    return p.where("labeled"), p.where("NOT labeled")


@query("c14_nearest_labeled", LAB + " SELECT u.vec_id AS id, round(min(list_distance(u.z, lb.z)), 5) AS distance FROM u, lb GROUP BY u.vec_id")
def c14(spark, d):
    labeled, pool = both(spark, d)
    return V.nearest_labeled(pool, labeled, "vec_id", "z").select("id", F.round("distance", 5).alias("distance"))


@query("j3_knn_density", """, p AS (SELECT a.vec_id AS id, b.vec_id AS other, round(list_distance(a.z, b.z), 9) AS dist FROM pool a, pool b WHERE a.vec_id <> b.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, other) AS r FROM p) SELECT id, round(1 / (1e-6 + avg(dist)), 5) AS density FROM k WHERE r <= 7 GROUP BY id""")
def j3(spark, d):
    return V.knn_density(X.pool(spark, d), "vec_id", "z").select("id", F.round("density", 5).alias("density"))


def greedy_sql(k: int) -> str:
    out = LAB + ", m0 AS (SELECT u.vec_id, any_value(u.z) AS z, min(round(list_distance(u.z, lb.z), 9)) AS md FROM u, lb GROUP BY u.vec_id)"
    for i in range(k):
        out += f", p{i} AS (SELECT vec_id, z FROM m{i} ORDER BY md DESC, vec_id LIMIT 1), m{i + 1} AS (SELECT m.vec_id, m.z, least(md, round(list_distance(m.z, p.z), 9)) AS md FROM m{i} m, p{i} p WHERE m.vec_id <> p.vec_id)"
    return out + " " + " UNION ALL ".join(f"SELECT CAST({i + 1} AS BIGINT) AS pick, vec_id FROM p{i}" for i in range(k))


@query("j1_coreset_greedy", greedy_sql(5))
def j1(spark, d):
    labeled, pool = both(spark, d)
    return V.coreset_greedy(labeled, pool, 5, "vec_id", "z")


DENSITY = LAB + """, fr AS (SELECT u.vec_id, min(round(1 - list_cosine_similarity(u.z, lb.z), 9)) AS md FROM u, lb GROUP BY u.vec_id),
np AS (SELECT a.vec_id, round(1 - list_cosine_similarity(a.z, b.z), 9) AS dd, b.vec_id AS other FROM u a, u b WHERE a.vec_id <> b.vec_id),
nk AS (SELECT vec_id, avg(1 - dd) AS den FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dd, other) AS r FROM np) WHERE r <= 10 GROUP BY vec_id),
m0 AS (SELECT u.vec_id, u.z, md, (den - min(den) OVER ()) / (max(den) OVER () - min(den) OVER () + 1e-8) AS den FROM u JOIN fr USING (vec_id) JOIN nk USING (vec_id))"""


def utility_sql(rows: str, name: str) -> str:
    return f", {name} AS (SELECT vec_id, z, round(0.5::DOUBLE * CASE WHEN max(md) OVER () > min(md) OVER () THEN (md - min(md) OVER ()) / (max(md) OVER () - min(md) OVER ()) ELSE md END + 0.5::DOUBLE * den, 9) AS utility FROM {rows})"


@query("j2_density_utility", DENSITY + utility_sql("m0", "ut") + " SELECT vec_id AS id, round(utility, 5) AS utility FROM ut")
def j2(spark, d):
    labeled, pool = both(spark, d)
    return V.density_scores(labeled, pool, "vec_id", "z").select("id", F.round("utility", 5).alias("utility"))


def density_sql(k: int) -> str:
    out = DENSITY
    for i in range(k):
        out += utility_sql(f"m{i}", f"u{i}") + f", p{i} AS (SELECT vec_id, z FROM u{i} ORDER BY utility DESC, vec_id LIMIT 1), m{i + 1} AS (SELECT m.vec_id, m.z, least(md, round(1 - list_cosine_similarity(m.z, p.z), 9)) AS md, den FROM m{i} m, p{i} p WHERE m.vec_id <> p.vec_id)"
    return out + " " + " UNION ALL ".join(f"SELECT CAST({i + 1} AS BIGINT) AS pick, vec_id FROM p{i}" for i in range(k))


@query("j2_density_coreset", density_sql(5))
def j2c(spark, d):
    labeled, pool = both(spark, d)
    return V.density_coreset(labeled, pool, 5, "vec_id", "z")


@query("k3_coreset_rounds", greedy_sql(6).replace(" SELECT CAST(1 AS BIGINT) AS pick", ", pk AS (SELECT CAST(1 AS BIGINT) AS pick", 1) + ") SELECT CAST(ceil(pick / 3.0) AS BIGINT) AS round, vec_id, user_id FROM pk JOIN pool USING (vec_id)")
def k3c(spark, d):
    """Two rounds of three core-set picks, with the users that they fall on."""
    labeled, _ = both(spark, d)
    pool = X.pool(spark, d)
    picked = A.active_learning_rounds(pool, labeled, A.coreset_picks("vec_id", "z", 3), 3, 2, "vec_id")
    return picked.join(pool.select("vec_id", "user_id"), "vec_id").select("round", "vec_id", "user_id")


@query("k3_kmeans_rounds")
def k3k(spark, d):
    """Per-user counts of two rounds of three picks by k-means from the labelled centroid."""
    labeled, _ = both(spark, d)
    pool = X.pool(spark, d)
    return A.user_counts(A.active_learning_rounds(pool, labeled, A.kmeans_picks("vec_id", "z", 3), 3, 2, "vec_id"), pool, "vec_id")


def rescored_sql(rounds: int, k: int) -> str:
    """Each round takes the k unlabelled rows nearest to the labelled rows' mean of the first component."""
    out = ", q0 AS (SELECT vec_id, 0 AS round FROM pool WHERE labeled)"
    for r in range(1, rounds + 1):
        out += f""", a{r} AS (SELECT avg(z[1]) AS m FROM pool JOIN q{r - 1} USING (vec_id)),
n{r} AS (SELECT vec_id FROM pool, a{r} WHERE vec_id NOT IN (SELECT vec_id FROM q{r - 1}) ORDER BY round(-abs(z[1] - m), 9) DESC, vec_id LIMIT {k}), q{r} AS (SELECT * FROM q{r - 1} UNION ALL SELECT vec_id, {r} FROM n{r})"""
    return out + f" SELECT vec_id, CAST(round AS BIGINT) AS round FROM q{rounds} WHERE round > 0"


def mean_scorer(rows):
    """The pool with a score that depends on what is labelled so far."""
    mean = rows.where("queried_round is not null").agg(F.avg(F.col("z")[0]).alias("_m"))
    return rows.crossJoin(F.broadcast(mean)).withColumn("score", -F.abs(F.col("z")[0] - F.col("_m"))).drop("_m")  # one row


@query("k3_rescored_rounds", rescored_sql(3, 5))
def k3r(spark, d):
    """Three rounds; the run stops after the first and goes on from the round table."""
    from ..sources.paths import scratch

    labeled, _ = both(spark, d)
    state, pick = scratch(spark, "rounds"), A.score_picks("score", 5, "vec_id")
    A.active_learning_rounds(X.pool(spark, d), labeled, pick, 5, 1, "vec_id", state, mean_scorer)
    return A.active_learning_rounds(X.pool(spark, d), labeled, pick, 5, 3, "vec_id", state, mean_scorer).select("vec_id", "round")


CENTERS = """, mc AS (SELECT cluster, i, avg(z[i]) AS m FROM pool, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL), ce AS (SELECT cluster, list(m ORDER BY i) AS c FROM mc GROUP BY cluster)"""


@query("j10_nearest_centroid", CENTERS + " SELECT id, cluster FROM (SELECT vec_id AS id, ce.cluster, row_number() OVER (PARTITION BY vec_id ORDER BY round(list_distance(z, c), 9), ce.cluster) AS r FROM pool, ce) WHERE r = 1")
def j10(spark, d):
    p = X.pool(spark, d)
    return V.nearest_centroid_assign(p, V.centroids(p, "cluster", "z"), "vec_id", "z")


@query("e8_rank_in_cluster", CENTERS + " SELECT vec_id, pool.cluster, row_number() OVER (PARTITION BY pool.cluster ORDER BY round(list_distance(z, c), 9), vec_id) AS rank FROM pool JOIN ce ON ce.cluster = pool.cluster")
def e8(spark, d):
    return V.rank_by_centroid(X.pool(spark, d), "cluster", "vec_id", "z").select("vec_id", "cluster", "rank")


@query("j8_typiclust", LAB + """, np AS (SELECT a.vec_id, a.cluster, round(list_distance(a.z, b.z), 9) AS dd, b.vec_id AS other FROM u a JOIN u b ON a.cluster = b.cluster AND a.vec_id <> b.vec_id),
ga AS (SELECT vec_id, avg(dd) AS gap FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dd, other) AS r FROM np) WHERE r <= 20 GROUP BY vec_id),
cv AS (SELECT cluster, count(*) AS cover FROM lb GROUP BY cluster),
rk AS (SELECT vec_id, u.cluster, row_number() OVER (PARTITION BY u.cluster ORDER BY round(gap, 9), vec_id) + coalesce(cover, 0) AS turn, count(*) OVER (PARTITION BY u.cluster) AS size FROM u LEFT JOIN ga USING (vec_id) LEFT JOIN cv ON cv.cluster = u.cluster)
SELECT vec_id, cluster FROM rk ORDER BY turn, size DESC, cluster LIMIT 25""")
def j8(spark, d):
    labeled, pool = both(spark, d)
    return V.typiclust(labeled, pool, 25, "vec_id", "z", "cluster")


@query("j9_hybrid", """, sc AS (SELECT *, round(1 - abs(2 * (1 / (1 + exp(-z[1] * 4))) - 1), 6) AS un FROM pool),
tp AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY un DESC, vec_id) AS r, count(*) OVER () AS n FROM sc) WHERE r <= greatest(15, ceil(0.2 * n))),
nz AS (SELECT vec_id, cluster, list_transform(z, lambda x: x / (sqrt(list_dot_product(z, z)) + 1e-8)) AS z FROM tp),
mc AS (SELECT cluster, i, avg(z[i]) AS m FROM nz, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL), ce AS (SELECT cluster, list(m ORDER BY i) AS c FROM mc GROUP BY cluster),
ds AS (SELECT vec_id, nz.cluster, round(list_distance(z, c), 9) AS dist FROM nz JOIN ce ON ce.cluster = nz.cluster),
rk AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY dist, vec_id) AS r, min(dist) OVER (PARTITION BY cluster) AS best FROM ds)
SELECT vec_id, cluster FROM rk ORDER BY r, best, cluster LIMIT 15""")
def j9(spark, d):
    p = X.pool(spark, d).withColumn("un", r6(1 - F.abs(2 * (1 / (1 + F.exp(-F.col("z")[0] * 4))) - 1)))
    return V.hybrid_uncertainty_typiclust(p, 15, "vec_id", "z", "cluster", "un")


REP = """, f AS (SELECT vec_id, [list_avg(z[1:30]), list_stddev_pop(z[1:30]), list_avg(z[31:60]), list_stddev_pop(z[31:60])] AS z FROM pool),
c AS (SELECT [avg(z[1]), avg(z[2]), avg(z[3]), avg(z[4])] AS c FROM f), p0 AS (SELECT vec_id, z FROM f, c ORDER BY round(list_distance(z, c), 9), vec_id LIMIT 1),
m1 AS (SELECT f.vec_id, f.z, round(list_distance(f.z, p.z), 9) AS md FROM f, p0 p WHERE f.vec_id <> p.vec_id)"""


def rep_sql(k: int) -> str:
    out = REP
    for i in range(1, k):
        out += f", p{i} AS (SELECT vec_id, z FROM m{i} ORDER BY md DESC, vec_id LIMIT 1), m{i + 1} AS (SELECT m.vec_id, m.z, least(md, round(list_distance(m.z, p.z), 9)) AS md FROM m{i} m, p{i} p WHERE m.vec_id <> p.vec_id)"
    return out + " " + " UNION ALL ".join(f"SELECT CAST({i + 1} AS BIGINT) AS pick, vec_id FROM p{i}" for i in range(k))


REP_SQL = rep_sql(5).replace(" SELECT CAST(1 AS BIGINT) AS pick", ", pk AS (SELECT CAST(1 AS BIGINT) AS pick", 1) + ") SELECT vec_id FROM pk, (SELECT count(*) AS n FROM pool) WHERE pick <= greatest(1, floor((1 - 0.99::DOUBLE) * n))"


def summary_features(spark, d):
    a, b = F.slice("z", 1, 30), F.slice("z", 31, 30)
    return X.pool(spark, d).select("vec_id", F.array(C.seq_mean(a), C.seq_std(a), C.seq_mean(b), C.seq_std(b)).alias("z"))


@query("j7_representative_seed", REP_SQL)  # the SQL holds five picks: as many as a hundredth of 500 to 599 rows
def j7(spark, d):
    return P.representative_seed(summary_features(spark, d), 0.99, "vec_id", "z", "kcenter").select("vec_id")


@query("j7_representative_kmeans")
def j7k(spark, d):
    return P.representative_seed(summary_features(spark, d), 0.99, "vec_id", "z", "kmeans").select("vec_id")


@query("j4_kmeans_query")
def j4(spark, d):
    labeled, pool = both(spark, d)
    return V.kmeans_query(labeled, pool, 8, "vec_id", "z")


@query("j5_centroid_seed")
def j5(spark, d):
    return V.centroid_seed(X.pool(spark, d), 2, "vec_id", "z")


@query("j5_centroid_split")
def j5s(spark, d):
    """Both sides: the seeds, and all other rows with hidden labels."""
    return V.centroid_split(X.pool(spark, d), 2, "vec_id", "z").select("vec_id", "labeled", "state_val", "true_label")


@query("j6_pca_kcenter")
def j6(spark, d):
    return V.pca_kcenter_split(X.pool(spark, d), 10, "vec_id", "z")


@query("i14_adasyn", """, sz AS (SELECT state_val, count(*) AS n FROM pool GROUP BY state_val), mi AS (SELECT state_val AS y, n FROM sz ORDER BY n, state_val DESC LIMIT 1), wt AS (SELECT max(sz.n) - any_value(mi.n) AS want FROM sz, mi),
few AS (SELECT pool.* FROM pool, mi WHERE state_val = y),
nr AS (SELECT a.vec_id, b.state_val, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_distance(a.z, b.z), 9), b.vec_id) AS j FROM few a, pool b WHERE a.vec_id <> b.vec_id),
sh AS (SELECT vec_id, avg(CASE WHEN state_val <> y THEN 1.0::DOUBLE ELSE 0 END) AS r FROM nr, mi WHERE j <= 5 GROUP BY vec_id),
gs AS (SELECT vec_id, CAST(round_even(CASE WHEN sum(r) OVER () > 0 THEN r / sum(r) OVER () ELSE 1.0::DOUBLE / count(*) OVER () END * want, 0) AS BIGINT) AS g FROM sh, wt),
cp AS (SELECT vec_id, copy, CAST('0x' || substr(md5('42:' || vec_id || ':' || copy), 1, 8) AS BIGINT) AS u FROM (SELECT vec_id, unnest(range(1, g + 1)) AS copy FROM gs WHERE g > 0)),
mt AS (SELECT a.vec_id, a.z AS az, b.z AS bz, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_distance(a.z, b.z), 9), b.vec_id) AS j FROM few a, few b WHERE a.vec_id <> b.vec_id),
mn AS (SELECT *, count(*) OVER (PARTITION BY vec_id) AS n FROM mt WHERE j <= 5)
SELECT cp.vec_id AS source, CAST(copy AS INTEGER) AS copy, round(az[1] + ((u / 65536.0::DOUBLE) % 1000) / 1000 * (bz[1] - az[1]), 6) AS z1 FROM cp JOIN mn ON mn.vec_id = cp.vec_id AND j = u % n + 1""")
def i14(spark, d):
    return V.adasyn(X.pool(spark, d), "vec_id", "z").select("source", "copy", r6(F.col("z")[0]).alias("z1"))


@query("h13_flip", " SELECT vec_id, round(z[30], 6) AS a, round(z[1], 6) AS b FROM pool")
def h13f(spark, d):
    s = X.pool(spark, d).select("vec_id", G.flip(F.slice("z", 1, 30)).alias("s"))
    return s.select("vec_id", r6(F.col("s")[0]).alias("a"), r6(F.col("s")[29]).alias("b"))


UNIT = "CAST('0x' || substr(md5('5:' || vec_id || ':{}'), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE"


@query("h13_slice_pad", f""", n AS (SELECT vec_id, z, 24 + CAST(floor({UNIT.format('n')} * 7) AS BIGINT) AS n FROM pool), s AS (SELECT *, 1 + CAST(floor({UNIT.format('s')} * (31 - n)) AS BIGINT) AS s FROM n)
SELECT vec_id, round(z[s], 6) AS first, round(z[s + n - 1], 6) AS last_edge, round(CASE WHEN n = 30 THEN z[s + n - 1] ELSE 0 END, 6) AS last_zero FROM s""")
def h13s(spark, d):
    z = F.slice("z", 1, 30)
    s = X.pool(spark, d).select("vec_id", G.slice_pad(z, True, 5, "vec_id").alias("e"), G.slice_pad(z, False, 5, "vec_id").alias("o"))
    return s.select("vec_id", r6(F.col("e")[0]).alias("first"), r6(F.col("e")[29]).alias("last_edge"), r6(F.col("o")[29]).alias("last_zero"))


def unit_sql(*keys: str) -> str:
    return "CAST('0x' || substr(md5(" + " || ':' || ".join(["'3'", "vec_id", *(f"'{k}'" for k in keys)]) + "), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE"


def normal_sql(*keys: str) -> str:
    return f"sqrt(-2 * ln(greatest({unit_sql(*keys, 'a')}, 1e-9))) * cos(2 * 3.141592653589793::DOUBLE * {unit_sql(*keys, 'b')})"


@query("h13_noise_stretch", f""", sq AS (SELECT vec_id, z[1:30] AS q, list_avg(z[1:30]) AS m, list_stddev_pop(z[1:30]) AS sd FROM pool), ss AS (SELECT vec_id, list_transform(q, lambda x: CASE WHEN sd > 1e-12 THEN (x - m) / sd ELSE 0 END) AS s FROM sq),
nn AS (SELECT *, CAST(greatest(1, round_even(30 * (0.8::DOUBLE + 0.4::DOUBLE * ({unit_sql()})), 0)) AS BIGINT) AS n FROM ss), ps AS (SELECT *, CASE WHEN n >= 30 THEN 841.0::DOUBLE / (n - 1) ELSE 29 END AS p FROM nn)
SELECT vec_id, round(s[1] + 0.05::DOUBLE * {normal_sql('0')}, 6) AS jitter, round(s[1] * (1 + 0.1::DOUBLE * {normal_sql('scale')}) + 0.05::DOUBLE * {normal_sql('0')}, 6) AS noise,
round(s[CAST(floor(p) AS BIGINT) + 1] + (p - floor(p)) * (s[least(CAST(floor(p) AS BIGINT) + 2, 30)] - s[CAST(floor(p) AS BIGINT) + 1]), 6) AS stretched, 30 AS n FROM ps""")
def h13n(spark, d):
    z = zscore_seq(F.slice("z", 1, 30))
    p = X.pool(spark, d).select("vec_id", z.alias("s"))
    out = p.select("vec_id", G.jitter(F.col("s"), 0.05, 3, "vec_id").alias("j"), G.noise_scale(F.col("s"), 0.05, 0.1, 3, "vec_id").alias("n"), G.stretch_crop("s", 0.8 + 0.4 * hash_unit(3, "vec_id")).alias("t"))
    return out.select("vec_id", r6(F.col("j")[0]).alias("jitter"), r6(F.col("n")[0]).alias("noise"), r6(F.col("t")[29]).alias("stretched"), F.size("t").alias("n"))
