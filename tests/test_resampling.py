"""Resampling down a tree over score ranges against plain resampling."""

import tracemalloc

import numpy as np
import pytest

from pulseframe.operators import metrics as M
from pulseframe.operators import resampling as R


def plain(scores, y, frac, iterations, seed=0):
    """Mean and deviation of the auc over NumPy's own resamples."""
    r, out = np.random.default_rng(seed), []
    for _ in range(iterations):
        i = r.integers(0, len(y), round(frac * len(y)))
        values, cell = np.unique(scores[i], return_inverse=True)
        pos, neg = (np.bincount(cell[y[i] == c], minlength=len(values))[None] for c in (1, 0))
        out.append(M.auc_of(pos, neg)[0])
    return np.nanmean(out), np.nanstd(out, ddof=1)


@pytest.mark.parametrize("digits", [1, 6])
def test_moments_over_many_leaves(spark, monkeypatch, digits):
    """Few scores of many rows, and nearly as many scores as rows: as in plain resampling, and tasks agree on k."""
    monkeypatch.setattr(R, "LEAF", 60)
    r = np.random.default_rng(3)
    y = (r.random(900) < 0.35).astype(int)
    s = np.round(np.clip(r.normal(0.4 + 0.12 * y, 0.2), -0.2, 1.2), digits)
    df = spark.createDataFrame([(g, int(a), float(b)) for g in (1, 2) for a, b in zip(y, s)] + [(3, 1, 0.5), (3, 0, 0.5)], "user_id long, y_true long, y_score double")
    found = {x["user_id"]: x for x in M.bootstrap_auc(df, ["user_id"], iterations=600).collect()}
    mean, std = plain(s, y, 0.7, 1500)
    for g in (1, 2):
        assert found[g]["auc_mean"] == pytest.approx(mean, abs=0.003) and found[g]["auc_std"] == pytest.approx(std, rel=0.12) and found[g]["valid"] == 1
    assert found[1]["auc_mean"] != found[2]["auc_mean"] and found[3]["auc_mean"] is None and found[3]["valid"] == 0  # one draw
    parts, tall = R.resample(M.by_score(df, ["user_id"]), ["user_id"], lambda s, p, q: R.auc_parts(p, q), "p long, n long, u double", 0.7, 600, 42)
    drawn = parts.groupBy("user_id", "iteration").agg({"p": "sum", "n": "sum", "leaf": "count"}).collect()
    assert tall and all(x["sum(p)"] + x["sum(n)"] == (630 if x["user_id"] < 3 else 1) for x in drawn) and max(x["count(leaf)"] for x in drawn) > 3


def test_thresholds_over_many_leaves(spark, monkeypatch):
    r = np.random.default_rng(4)
    rows = [(int(r.random() < 0.4), float(np.round(r.random() * 1.1 - 0.05, 3))) for _ in range(800)]
    df = spark.createDataFrame(rows, "y_true long, y_score double").selectExpr("1 as g", "*")
    one = {x["k"]: x for x in M.bootstrap_thresholds(df, ["g"], iterations=500).collect()}
    monkeypatch.setattr(R, "LEAF", 50)
    many = {x["k"]: x for x in M.bootstrap_thresholds(df, ["g"], iterations=500).collect()}
    assert sorted(one) == sorted(many) == list(range(101))
    for k in one:
        for m in (*M.THRESHOLD_METRICS, "auc"):
            assert many[k][f"{m}_mean"] == pytest.approx(one[k][f"{m}_mean"], abs=0.006) and many[k][f"{m}_std"] == pytest.approx(one[k][f"{m}_std"], abs=0.006)


def test_draws_are_the_sqls(monkeypatch):
    """Row numbers as plain integers give them, at the ends of the generator's range; counts do not depend on the steps."""
    top = R.PRIME - 1
    seeds = np.array([[top, top, top], [0, 0, 0], [1, top, 0], [0, 1, top], [123_456_789, 987_654_321, 55]])
    for first, n in ((1, 600), (45_000, R.LEAF), (2_000_000_000, R.LEAF - 1), (1, 1)):
        mine = R.draw_rows(seeds, first, 300, n)
        assert mine.tolist() == [[(pow(a * j + b, 5, R.PRIME) + c) % R.PRIME % n for j in range(first, first + 300)] for a, b, c in seeds.tolist()]
    sizes, draws = np.array([3, 0, 40, 7]), np.array([35, 0, 50, 1, 12])
    whole = R.single_draws(sizes, seeds, draws)
    monkeypatch.setattr(R, "CACHED", 16)
    assert (R.single_draws(sizes, seeds, draws) == whole).all() and whole.sum(axis=1).tolist() == draws.tolist()


def test_small_groups_take_all_iterations_together(spark):
    """One call of the measure for a small group, its iterations in order, whatever else is in the same unit; keys of odd types."""
    rows = [(f"u{g}", g % 3 == 0, bool(i % 2), i / 7) for g in range(60) for i in range(1 + g % 11)]
    hist = M.by_score(spark.createDataFrame(rows, "user string, odd boolean, y boolean, y_score double").selectExpr("user", "odd", "int(y) as y_true", "y_score"), ["user", "odd"])
    found, tall = R.resample(hist, ["user", "odd"], lambda s, p, q: {"at": np.arange(1), "wide": np.array([len(p)]), "drawn": np.array([(p + q).sum()]), "first": s[:1]}, "wide long, drawn long, first double", 0.7, 1000, 42)
    got = sorted(tuple(r) for r in found.select("user", "odd", "leaf", "iteration", "wide", "drawn", "first").collect())
    assert not tall and got == sorted((f"u{g}", g % 3 == 0, 0, 0, 1000, 1000 * round(0.7 * (1 + g % 11)), 0.0) for g in range(60))


def test_moments_equal_those_over_single_iterations(spark, monkeypatch):
    """Groups in one unit and in many, with few or no iterations of both classes: one row from Python for each span of iterations."""
    from pyspark.sql import functions as F

    r = np.random.default_rng(5)
    rows = [(g, int(r.random() < p), float(np.round(r.random(), 2))) for g, n, p in ((1, 300, 0.3), (2, 12, 0.1), (3, 2, 0.5), (4, 40, 0.0), (5, 3, 0.5)) for _ in range(n)] + [(5, 0, 0.1), (5, 1, 0.1)]
    df = spark.createDataFrame(rows, "user_id long, y_true long, y_score double")
    parts, _ = R.resample(M.by_score(df, ["user_id"]), ["user_id"], lambda s, p, q: R.auc_parts(p, q), "p long, n long, u double", 0.7, 330, 42)
    want = R.auc_by_iteration(parts, ["user_id"], False).groupBy("user_id").agg(F.avg("auc"), F.stddev_samp("auc"), F.count("auc") / 330).collect()
    for draws in (R.TASK_DRAWS, 10_000):
        monkeypatch.setattr(R, "TASK_DRAWS", draws)
        found = {x["user_id"]: x for x in M.bootstrap_auc(df, ["user_id"], iterations=330).collect()}
        assert len(found) == len(want) == 5
        for u, *values in want:
            assert [found[u][c] for c in ("auc_mean", "auc_std", "valid")] == [None if v is None else pytest.approx(v, abs=1e-12) for v in values]
    assert R.joined_moments(spark.createDataFrame([(1, 0, 0, 0.0, 0.0), (1, 50, 1, 0.25, 0.0), (1, 100, 3, 0.75, 0.5)], "g long, iteration long, count long, mean double, m2 double"), ["g"]).collect() == [(1, 4, 0.625, 0.6875)]


def test_memory_does_not_grow_with_rows():
    """99 scores with 20 thousand and with 20 billion rows: the same memory, and counts in proportion."""
    peaks = []
    for rows in (20_000, 20_000_000_000):
        sizes = np.full(198, rows // 198)
        tracemalloc.start()
        counts = R.cell_counts(sizes, "g", range(0, 50), np.full(50, round(0.7 * sizes.sum())))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert (counts.sum(axis=1) == round(0.7 * sizes.sum())).all() and counts.mean() == pytest.approx(0.7 * sizes[0], rel=1e-3)
    assert peaks[1] <= peaks[0]


def test_cells_are_binomial():
    """Counts of a cell over iterations: mean and variance of Binomial(k, share), also beyond the generator's modulus."""
    sizes = np.array([3_000_000_000, 40_000, 1_000_000_000, 10])
    k = np.full(50, 1_000_000)
    counts = np.concatenate([R.cell_counts(sizes, "g", range(i, i + 50), k) for i in range(0, 2000, 50)])
    share = sizes / sizes.sum()
    assert counts.mean(axis=0) == pytest.approx(1e6 * share, rel=0.01, abs=0.5)
    assert counts[:, :3].var(axis=0) == pytest.approx(1e6 * (share * (1 - share))[:3], rel=0.12)
