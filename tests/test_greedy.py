"""Farthest-first picks and k-means in few jobs, against NumPy."""

import numpy as np
import pytest

from pulseframe.operators import vectors as V


def frame(spark, z):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(z)], "id long, z array<double>").repartition(4)


def jobs_of(spark, run):
    spark.sparkContext.setJobGroup("greedy", "counted")
    out = run()
    n = len(spark.sparkContext.statusTracker().getJobIdsForGroup("greedy"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, n


def farthest(z, centers, k):
    d = np.round(np.linalg.norm(z[:, None] - centers[None], axis=2), 9).min(axis=1)
    out = []
    for _ in range(min(k, len(z))):
        at = int(np.lexsort((np.arange(len(z)), -d))[0])
        out.append(at)
        d = np.minimum(d, np.round(np.linalg.norm(z - z[at], axis=1), 9))
        d[out] = -1
    return out


@pytest.mark.parametrize("candidates", [4, 256])
def test_picks_equal_one_by_one(spark, monkeypatch, candidates):
    monkeypatch.setattr(V, "CANDIDATES", candidates)
    r = np.random.default_rng(1)
    z = np.concatenate((r.normal(0, 1, (200, 3)), np.zeros((30, 3)), np.ones((5, 3)))).round(2)  # with ties
    labeled = np.array([[0.0, 0, 0], [2, 2, 2]])
    lab = spark.createDataFrame([(1000 + i, v.tolist()) for i, v in enumerate(labeled)], "id long, z array<double>")
    found = [x["id"] for x in V.coreset_greedy(lab, frame(spark, z), 60, "id", "z").orderBy("pick").collect()]
    assert found == farthest(z, labeled, 60)
    few = [x["id"] for x in V.coreset_greedy(lab, frame(spark, z[:7]), 60, "id", "z").orderBy("pick").collect()]
    assert few == farthest(z[:7], labeled, 60)


def test_jobs_grow_far_slower_than_picks(spark):
    z = np.random.default_rng(2).normal(0, 1, (5000, 4))
    start = frame(spark, z).selectExpr("id", "z", "cast(1e9 as double) as min_dist")
    counts = []
    for k in (50, 400):
        found, jobs = jobs_of(spark, lambda: V.farthest_picks(start, k, "id", "z"))
        assert len({i for i, _ in found}) == k
        counts.append(jobs)
    assert counts[1] <= 40 and counts[1] < 3 * counts[0]


def test_many_centers(spark):
    """k = 1 % of the pool: assignment and means as NumPy's, every pick another row, few jobs."""
    r = np.random.default_rng(3)
    z = np.round(r.normal(0, 1, (40, 5))[r.integers(0, 40, 4000)] * 5 + r.normal(0, 0.1, (4000, 5)), 3)
    centers = z[r.choice(4000, 40, replace=False)]
    d = ((z[:, None] - centers[None]) ** 2).sum(axis=2)
    assert (V.nearest_center(z, centers, 7) == d.argmin(axis=1)).all()
    after = V.lloyd_step(frame(spark, z), centers, "z")
    assert after == pytest.approx(np.array([z[d.argmin(axis=1) == j].mean(axis=0) for j in range(40)]))
    found, jobs = jobs_of(spark, lambda: V.kmeans_query(frame(spark, z).limit(0), frame(spark, z), 40, "id", "z", max_iter=5).collect())
    assert len({x["id"] for x in found}) == 40 and jobs <= 60


def test_plane_equals_numpy(spark):
    from pulseframe.operators import rollups as R

    r = np.random.default_rng(5)
    z = r.normal(0, (3, 2, 0.5, 0.1), (6, 4))
    rows = [(u, (z[u] + d).tolist()) for u in range(6) for d in (-1.0, 1.0)]
    means = R.representation_means(spark.createDataFrame(rows, "user_id long, z array<double>"), "user_id", "z")
    found = {x["user_id"]: (x["x"], x["y"]) for x in R.representation_plane(means, "user_id").collect()}
    c = z - z.mean(axis=0)
    _, _, v = np.linalg.svd(c)
    want = c @ np.array([p * np.sign(p[abs(p).argmax()]) for p in v[:2]]).T
    assert np.array([found[u] for u in range(6)]) == pytest.approx(want)
    assert [tuple(x) for x in R.representation_plane(means.where("user_id = 1"), "user_id").collect()] == [(1, 0.0, 0.0)]


def test_centroid_split_hides_the_rest(spark):
    z = np.random.default_rng(6).normal(0, 1, (30, 3))
    df = frame(spark, z).selectExpr("id", "z", "cast(id % 2 as long) as state_val")
    out = V.centroid_split(df, 2, "id", "z").collect()
    assert len(out) == 30 and sum(r["labeled"] for r in out) == 4
    assert all(r["true_label"] == r["id"] % 2 and r["state_val"] == (r["true_label"] if r["labeled"] else -1) for r in out)
