"""Operators over embedding tables: densities, core-sets, clusters, all upon the nearest rows of `neighbors`. Vectors are array<double>."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import Window as W

from ..functions.scalars import l2_normalize
from ..hashing import hash_key, with_position
from ..shipping import ship
from ..sources.paths import checkpoints
from .neighbors import nearest

def nearest_labeled(unlabeled: DataFrame, labeled: DataFrame, key: str, vector: str, metric: str = "euclidean") -> DataFrame:
    """id, distance to the nearest labelled row."""
    return nearest(unlabeled, labeled, 1, key, vector, metric=metric).select("id", "distance")


def knn_density(pool: DataFrame, key: str, vector: str, k: int = 7, by: list[str] = ()) -> DataFrame:
    """id, density: 1 / (1e-6 + mean distance to the k nearest)."""
    return nearest(pool, pool, k, key, vector, by).groupBy("id").agg((1 / (1e-6 + F.avg("distance"))).alias("density"))


#: Buckets of a unit of distance, so that a cluster's rows are ranked in many tasks.
RANK_BUCKETS = 512


def distance_to(vector: str, point: list[float], metric: str = "euclidean"):
    p = F.array(*[F.lit(float(x)) for x in point])
    if metric == "cosine":
        dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        return F.round(1 - dot(F.col(vector), p) / ((F.sqrt(dot(F.col(vector), F.col(vector))) + 1e-12) * (F.sqrt(dot(p, p)) + 1e-12)), 9)
    return F.round(F.sqrt(F.aggregate(F.zip_with(vector, p, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)), 9)


#: Candidates of the first round, and most rows that a round brings to the driver.
CANDIDATES, MOST_CANDIDATES = 256, 32_768


def gaps_to(z: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """(rows, centers): Euclidean distances, rounded to 9 places, by differences so that equal rows are at 0."""
    out = np.empty((len(z), len(centers)))
    for j, c in enumerate(centers):
        out[:, j] = np.round(np.sqrt(((z - c) ** 2).sum(axis=1)), 9)
    return out


def farthest_picks(start: DataFrame, k: int, key: str, vector: str) -> list[tuple]:
    """(id, vector) of k picks: each time the row with the largest min_dist (ties to smaller ids), which becomes a centre.

    Distances only fall, so those of an earlier round are upper bounds. A round brings the rows with the largest ones
    to the driver, and picks among them as long as the best of them, updated, still comes before every row outside;
    then one job updates all rows against the round's picks. Rounds take more and more candidates, up to a set number
    of rows. start: key, vector, min_dist.
    """
    checkpoints(start.sparkSession)
    ship(start.sparkSession)
    now, picked, width = start.select(key, vector, "min_dist").checkpoint(), [], CANDIDATES
    while len(picked) < k:
        top = now.orderBy(F.desc("min_dist"), key).limit(width).collect()  # MOST_CANDIDATES rows at most
        if not top:
            break
        whole = len(top) < width
        ids, z, left = [r[0] for r in top], np.array([r[1] for r in top], dtype=float), np.array([r[2] for r in top], dtype=float)
        rest, first, free = (left[-1], ids[-1]), len(picked), np.ones(len(top), dtype=bool)
        while len(picked) < k and free.any():
            best = np.flatnonzero(free & (left == left[free].max()))
            at = min(best, key=lambda i: ids[i])
            # a row outside is at most as far as the last candidate was, with a larger id where as far
            if not whole and (left[at] < rest[0] or left[at] == rest[0] and ids[at] > rest[1]):
                break
            picked.append((ids[at], top[at][1]))
            free[at] = False
            left = np.minimum(left, gaps_to(z, z[at : at + 1])[:, 0])
        if whole:
            break
        if len(picked) < k:
            now = updated(now, picked[first:], key, vector).checkpoint()
            width = min(2 * width, MOST_CANDIDATES)
    return picked


def updated(rows: DataFrame, centers: list[tuple], key: str, vector: str) -> DataFrame:
    """rows without the centres, min_dist lowered to their distance from them."""
    ids, z = {c[0] for c in centers}, np.array([c[1] for c in centers], dtype=float)

    def lower(frames):
        for f in frames:
            f = f[~f[key].isin(ids)]
            if len(f):
                own = np.stack(f[vector].to_numpy()).astype(float)
                yield f.assign(min_dist=np.minimum(f["min_dist"].to_numpy(), gaps_to(own, z).min(axis=1)))

    return rows.mapInPandas(lower, rows.schema)


def farthest_first(pool: DataFrame, start: DataFrame, score, k: int, key: str, vector: str, keep_every: int = 4, metric: str = "euclidean") -> list[tuple]:
    """The ids of k picks by a score that is scaled anew after each pick, so that every pick needs all rows.

    One row, the new centre, comes to the driver in each step; distances are only updated against it.
    """
    checkpoints(pool.sparkSession)
    now, picked = start.checkpoint(), []
    for i in range(k):
        top = now.withColumn("_score", score(now)).orderBy(F.desc("_score"), key).select(key, vector).first()
        if top is None:
            break
        picked.append(top[0])
        now = now.where(F.col(key) != top[0]).withColumn("min_dist", F.least("min_dist", distance_to(vector, top[1], metric)))
        if i % keep_every == keep_every - 1:
            now = now.checkpoint()
    return picked


def _picks(pool: DataFrame, ids: list, key: str) -> DataFrame:
    kind = dict(pool.dtypes)[key]
    return pool.sparkSession.createDataFrame([(i + 1, x) for i, x in enumerate(ids)], f"pick long, `{key}` {kind}")


def coreset_greedy(labeled: DataFrame, pool: DataFrame, k: int, key: str, vector: str) -> DataFrame:
    """pick, key: k times the pool row farthest from its nearest centre, which then becomes a centre."""
    start = pool.select(key, vector).join(nearest_labeled(pool, labeled, key, vector).select(F.col("id").alias(key), F.col("distance").alias("min_dist")), key)
    return _picks(pool, [p[0] for p in farthest_picks(start, k, key, vector)], key)


def density_parts(labeled: DataFrame, pool: DataFrame, key: str, vector: str, k: int = 10) -> DataFrame:
    """key, vector, min_dist (cosine, to the nearest labelled row), density: mean of the k largest similarities in the pool, scaled to 0..1."""
    far = nearest_labeled(pool, labeled, key, vector, "cosine").select(F.col("id").alias(key), F.col("distance").alias("min_dist"))
    near = nearest(pool, pool, k, key, vector, metric="cosine").groupBy(F.col("id").alias(key)).agg(F.avg(1 - F.col("distance")).alias("density"))
    ends = near.agg(F.min("density").alias("_lo"), F.max("density").alias("_hi"))
    scaled = near.crossJoin(F.broadcast(ends)).select(key, ((F.col("density") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-8)).alias("density"))  # one row
    return pool.select(key, vector).join(far, key).join(scaled, key)


def utility(rows: DataFrame, w: float):
    """(1 - w) * min_dist, scaled to 0..1 over rows unless constant, + w * density."""
    lo, hi = rows.agg(F.min("min_dist"), F.max("min_dist")).first()
    gap = (F.col("min_dist") - lo) / (hi - lo) if lo is not None and hi > lo else F.col("min_dist")
    return F.round((1 - w) * gap + w * F.col("density"), 9)


def density_scores(labeled: DataFrame, pool: DataFrame, key: str, vector: str, w: float = 0.5, k: int = 10) -> DataFrame:
    """id, utility of the pool's rows."""
    rows = density_parts(labeled, pool, key, vector, k)
    return rows.select(F.col(key).alias("id"), utility(rows, w).alias("utility"))


def density_coreset(labeled: DataFrame, pool: DataFrame, k: int, key: str, vector: str, w: float = 0.5, neighbors: int = 10) -> DataFrame:
    """pick, key of the k largest utilities. Density is fixed over the whole pool; each pick joins the labelled set, and distances are scaled over the rows left."""
    start = density_parts(labeled, pool, key, vector, neighbors)
    return _picks(pool, farthest_first(pool, start, lambda df: utility(df, w), k, key, vector, metric="cosine"), key)


def nearest_centroid_assign(df: DataFrame, centers: DataFrame, key: str, vector: str) -> DataFrame:
    """id, cluster: the nearest centre (ties to the smaller). centers: cluster, vector."""
    c = centers.select(F.col("cluster").alias(key), F.col(vector))
    shifted = df.select((-F.col(key) - 1).alias(key), F.col(vector))  # ids of rows and centres must not meet
    return nearest(shifted, c, 1, key, vector).select((-F.col("id") - 1).alias("id"), F.col("other").alias("cluster"))


def centroids(df: DataFrame, cluster: str, vector: str) -> DataFrame:
    """cluster, vector: mean vectors."""
    long = df.select(F.col(cluster).alias("cluster"), F.posexplode(vector)).groupBy("cluster", "pos").agg(F.avg("col").alias("m"))
    return long.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias(vector))  # a row's width


def rank_by_centroid(df: DataFrame, cluster: str, key: str, vector: str) -> DataFrame:
    """key, cluster, distance to the cluster's centroid, rank in it."""
    c = centroids(df, cluster, vector).select(F.col("cluster").alias("_c"), F.col(vector).alias("_m"))
    gap = F.round(F.sqrt(F.aggregate(F.zip_with(vector, "_m", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)), 9)
    d = df.join(c, F.col(cluster) == F.col("_c")).select(key, F.col(cluster).alias("cluster"), gap.alias("distance"))
    return with_position(d, ["cluster"], F.floor(F.col("distance") * RANK_BUCKETS), ["distance", key], "rank").drop("rank_n")


def typiclust(labeled: DataFrame, pool: DataFrame, k: int, key: str, vector: str, cluster: str, neighbors: int = 20) -> DataFrame:
    """key of k picks: the most typical row of the least covered cluster, ties to larger clusters, again and again."""
    near = nearest(pool, pool, neighbors, key, vector, [cluster]).groupBy("id").agg(F.avg("distance").alias("gap"))
    cover = labeled.groupBy(cluster).agg(F.count(F.lit(1)).alias("cover"))
    rows = pool.select(F.col(key), F.col(cluster)).join(near, F.col(key) == F.col("id"), "left").join(cover, cluster, "left").na.fill(0, ["cover"])
    gap = F.round("gap", 9)
    rows = with_position(rows.withColumn("_gap", F.coalesce(gap, F.lit(1e300))), [cluster], F.least(F.floor(F.col("_gap") * RANK_BUCKETS), F.lit(1 << 40)), ["_gap", key], "_place")
    rows = rows.withColumn("turn", F.col("_place") + F.col("cover"))
    return rows.orderBy("turn", F.desc("_place_n"), cluster).limit(k).select(key, cluster)


def hybrid_uncertainty_typiclust(pool: DataFrame, k: int, key: str, vector: str, cluster: str, score: str, frac: float = 0.2) -> DataFrame:
    """key of k picks: among the most uncertain, the rows nearest to their clusters' centroids, one a cluster in cycles."""
    from .active import top_fraction

    top = top_fraction(pool, score, key, frac, k).withColumn(vector, l2_normalize(F.col(vector)))
    r = rank_by_centroid(top, cluster, key, vector)
    best = r.where("rank = 1").select("cluster", F.col("distance").alias("_best"))
    return r.where(F.col("rank") <= k).join(best, "cluster").orderBy("rank", "_best", "cluster").limit(k).select(key, "cluster")


def kcenter_seed(df: DataFrame, k: int, key: str, vector: str) -> DataFrame:
    """pick, key: k-centre picks, from the row nearest to the centroid on."""
    center = df.select(F.posexplode(vector)).groupBy("pos").agg(F.avg("col").alias("m")).orderBy("pos").collect()  # a row's width
    start = df.select(key, vector, distance_to(vector, [r["m"] for r in center]).alias("d"))
    first = start.orderBy("d", key).first()
    rest = start.where(F.col(key) != first[0]).select(key, vector, distance_to(vector, first[1]).alias("min_dist"))
    return _picks(df, [first[0], *(p[0] for p in farthest_picks(rest, k - 1, key, vector))], key)


def nearest_center(z: np.ndarray, centers: np.ndarray, step: int = 256) -> np.ndarray:
    """The nearest centre of each row, ties to the first; by blocks of centres, near ties by differences."""
    best, own = np.full(len(z), np.inf), np.zeros(len(z), dtype=np.int64)
    for at in range(0, len(centers), step):
        part = centers[at : at + step]
        d = (z * z).sum(1)[:, None] + (part * part).sum(1)[None] - 2 * z @ part.T
        slack = 1e-9 * (1 + np.abs(d).max(initial=0))
        rows, close = np.nonzero(d <= np.minimum(d.min(axis=1), best)[:, None] + slack)
        exact = ((z[rows] - part[close]) ** 2).sum(axis=1)
        order = np.lexsort((close, exact, rows))
        rows, close, exact = rows[order], close[order], exact[order]
        first = np.flatnonzero(np.diff(rows, prepend=-1))
        rows, close, exact = rows[first], close[first], exact[first]
        better = exact < best[rows]
        best[rows[better]], own[rows[better]] = exact[better], at + close[better]
    return own


def lloyd_step(pool: DataFrame, centers: np.ndarray, vector: str) -> np.ndarray:
    """The mean of the rows nearest to each centre; a centre without rows stays. A row per task and centre is summed up."""

    def sums(frames):
        total, n = np.zeros_like(centers), np.zeros(len(centers), dtype=np.int64)
        for f in frames:
            if len(f):
                z = np.stack(f[vector].to_numpy()).astype(float)
                own = nearest_center(z, centers)
                np.add.at(total, own, z)
                n += np.bincount(own, minlength=len(centers))
        if len(held := np.flatnonzero(n)):
            yield pd.DataFrame({"cluster": held, "n": n[held], "total": [t.tolist() for t in total[held]]})

    ship(pool.sparkSession)
    parts = pool.select(vector).mapInPandas(sums, "cluster long, n long, total array<double>")
    means = parts.select("cluster", "n", F.posexplode("total")).groupBy("cluster", "pos").agg((F.sum("col") / F.sum("n")).alias("m")).collect()  # k rows of a row's width
    out = centers.copy()
    for r in means:
        out[r["cluster"], r["pos"]] = r["m"]
    return out


def nearest_per_center(data: DataFrame, centers: np.ndarray, wanted: list[int], many: int, key: str, vector: str) -> dict[int, list]:
    """For each wanted centre the ids of its `many` nearest rows, nearest first, ties to smaller ids; one job."""
    points = centers[wanted]

    def best(frames):
        for f in frames:
            if not len(f):
                continue
            z, ids = np.stack(f[vector].to_numpy()).astype(float), f[key].to_numpy()
            for j, c in zip(wanted, points, strict=True):
                d = np.round(np.sqrt(((z - c) ** 2).sum(axis=1)), 9)
                at = np.lexsort((ids, d))[:many]
                yield pd.DataFrame({"cluster": j, key: ids[at], "d": d[at]})

    ship(data.sparkSession)
    found = data.mapInPandas(best, f"cluster long, `{key}` {dict(data.dtypes)[key]}, d double")
    found = found.withColumn("r", F.row_number().over(W.partitionBy("cluster").orderBy("d", key))).where(F.col("r") <= many)
    out = {j: [] for j in wanted}
    for r in found.orderBy("cluster", "r").collect():  # many rows for each centre
        out[r["cluster"]].append(r[key])
    return out


def kmeans_query(labeled: DataFrame, pool: DataFrame, k: int, key: str, vector: str, max_iter: int = 50, tol: float = 1e-6) -> DataFrame:
    """cluster, key of k picks: for each of k centres fitted on the pool, the nearest row not picked yet (ties to smaller ids).

    Centres start as the labelled centroid (without labelled rows the pool's) and farthest-first picks from it. Only
    the centres and a few rows for each come to the driver; jobs are one a Lloyd step, and a few for all seeds and picks.
    """
    kind = dict(pool.dtypes)[key]
    k, picked = min(k, pool.count()), []
    if k > 0:
        mean = lambda df: [r["m"] for r in df.select(F.posexplode(vector)).groupBy("pos").agg(F.avg("col").alias("m")).orderBy("pos").collect()]  # noqa: E731  a row's width
        anchor = mean(labeled) or mean(pool)
        data = pool.select(key, vector).checkpoint()
        start = data.select(key, vector, distance_to(vector, anchor).alias("min_dist"))
        centers = np.array([anchor, *(z for _, z in farthest_picks(start, k - 1, key, vector))], dtype=float)
        for _ in range(max_iter):
            before, centers = centers, lloyd_step(data, centers, vector)
            if np.linalg.norm(centers - before) <= tol:
                break
        many, near, used = 4, nearest_per_center(data, centers, list(range(k)), 4, key, vector), set()
        for j in range(k):
            while not (free := [i for i in near[j] if i not in used]):  # all taken by earlier centres
                many *= 4
                near |= nearest_per_center(data, centers, list(range(j, k)), many, key, vector)
            picked.append(free[0])
            used.add(free[0])
    return pool.sparkSession.createDataFrame(list(enumerate(picked)), f"cluster long, `{key}` {kind}")


def kmeans_nearest(pool: DataFrame, k: int, key: str, vector: str, seed: int = 42) -> DataFrame:
    """cluster, key of the pool row nearest to each of k centres that Spark's k-means fits on the pool."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = pool.select(key, vector, array_to_vector(F.col(vector)).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=50, tol=1e-6).fit(data)
    centers = pool.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cluster long, center array<double>")  # k rows
    out = model.transform(data).select(key, F.col("prediction").cast("long").alias("cluster"), vector).join(F.broadcast(centers), "cluster")
    gap = F.aggregate(F.zip_with(vector, "center", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return out.groupBy("cluster").agg(F.min(F.struct(gap.alias("g"), F.col(key).alias("k")))["k"].alias(key))


def centroid_seed(df: DataFrame, n_per_class: int, key: str, vector: str, label: str = "state_val", seed: int = 42) -> DataFrame:
    """label, cluster, key: for each class the rows nearest to its n centres."""
    classes = [r[0] for r in df.select(label).distinct().orderBy(label).collect()]  # a row for each class
    parts = [kmeans_nearest(df.where(F.col(label) == c), n_per_class, key, vector, seed).withColumn(label, F.lit(c)) for c in classes]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def centroid_split(df: DataFrame, n_per_class: int, key: str, vector: str, label: str = "state_val", seed: int = 42) -> DataFrame:
    """df with labeled and true_label (in place of columns of these names): centroid_seed's rows keep their label, others are hidden as -1."""
    seeds = centroid_seed(df, n_per_class, key, vector, label, seed).select(key, F.lit(True).alias("labeled"))
    rows = df.drop("labeled", "true_label").join(seeds, key, "left").na.fill(False, ["labeled"])
    return rows.withColumn("true_label", F.col(label)).withColumn(label, F.when(F.col("labeled"), F.col(label)).otherwise(-1))


def pca_kcenter_split(df: DataFrame, n: int, key: str, vector: str, dims: int = 12, seed: int = 42) -> DataFrame:
    """key, labeled: rows nearest to n centres in the first principal components are labelled."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    data = df.select(key, array_to_vector(F.col(vector)).alias("features"))
    low = PCA(k=dims, inputCol="features", outputCol="low").fit(data).transform(data).select(key, vector_to_array("low").alias(vector))
    picked = kmeans_nearest(low, n, key, vector, seed).select(key, F.lit(True).alias("labeled"))
    return df.select(key).join(picked, key, "left").na.fill(False, ["labeled"])


def adasyn(df: DataFrame, key: str, vector: str, label: str = "state_val", k: int = 5, seed: int = 42) -> DataFrame:
    """source, copy, vector: synthetic minority rows, each row's share by how many of its k nearest are of the majority."""
    sizes = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}  # a row for each class
    minority = min(sizes, key=lambda c: (sizes[c], -c))
    want = max(sizes.values()) - sizes[minority]
    few = df.where(F.col(label) == minority)
    near = nearest(few, df, k, key, vector).join(df.select(F.col(key).alias("other"), F.col(label)), "other")
    share = near.groupBy("id").agg(F.avg((F.col(label) != minority).cast("double")).alias("r"))
    total = share.agg(F.sum("r").alias("total"), F.count(F.lit(1)).alias("m"))
    plan = share.crossJoin(F.broadcast(total)).withColumn("g", F.bround(F.when(F.col("total") > 0, F.col("r") / F.col("total")).otherwise(1 / F.col("m")) * want).cast("int"))  # one row
    copies = plan.where("g > 0").select("id", F.explode(F.sequence(F.lit(1), F.col("g"))).alias("copy"))
    mates = nearest(few, few, k, key, vector)
    mates = mates.withColumn("j", F.row_number().over(W.partitionBy("id").orderBy("distance", "other"))).withColumn("n", F.count(F.lit(1)).over(W.partitionBy("id")))
    unit = F.conv(F.substring(hash_key(seed, "id", "copy"), 1, 8), 16, 10).cast("long")
    chosen = copies.withColumn("u", unit).join(mates, "id").where(F.col("j") == F.col("u") % F.col("n") + 1)
    v = few.select(F.col(key).alias("id"), F.col(vector).alias("a")).join(chosen, "id").join(few.select(F.col(key).alias("other"), F.col(vector).alias("b")), "other")
    step = (F.col("u") / 65536 % 1000) / 1000
    return v.withColumn("_t", step).select(F.col("id").alias("source"), "copy", F.zip_with("a", "b", lambda x, y: x + F.col("_t") * (y - x)).alias(vector))
