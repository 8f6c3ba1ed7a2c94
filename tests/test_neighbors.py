"""Pruned nearest rows against all pairs, and how many pairs they compare."""

import numpy as np
import pytest

from pulseframe.operators import neighbors as N


def frame(spark, rows):
    return spark.createDataFrame([(int(i), None if v is None else [float(x) for x in v], g) for i, v, g in rows], "id long, z array<double>, g string")


def brute(left, right, k, metric, by):
    out = []
    for i, v, g in left:
        near = []
        for j, w, h in right:
            if v is None or w is None or i == j or by and (g is None or g != h):
                continue
            near.append((round(float(N.MEASURES[metric](np.array([v], dtype=float), np.array([w], dtype=float))[0, 0]), 6), j))
        out += [(i, j, d) for d, j in sorted(near)[:k]]
    return out


def clustered(n, centers, seed, dims=8, spread=0.05):
    r = np.random.default_rng(seed)
    c = r.normal(0, 1, (centers, dims)) * 4
    return c[r.integers(0, centers, n)] + r.normal(0, spread, (n, dims))


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
@pytest.mark.parametrize("by", [[], ["g"]])
def test_equal_all_pairs(spark, monkeypatch, metric, by):
    monkeypatch.setattr(N, "CELL", 8)
    monkeypatch.setattr(N, "BLOCK", 20)
    z = np.concatenate((clustered(150, 9, 1, 3), np.random.default_rng(2).normal(0, 3, (60, 3))))
    rows = [(i, v, "abc"[i % 3] if i % 17 else None) for i, v in enumerate(np.round(z, 3))]
    rows += [(500 + i, z[0].round(3), "a") for i in range(40)] + [(600, [0, 0, 0], "a"), (601, [0, 0, 0], "b"), (602, None, "a")]  # one hot vector, zero vectors
    left, right = rows[::2] + rows[-3:], rows
    for k in (1, 5):
        found = sorted((r["id"], r["other"], round(r["distance"], 6)) for r in N.nearest(frame(spark, left), frame(spark, right), k, "id", "z", by, metric).collect())
        want = sorted(set(brute(left, right, k, metric, by)))
        assert len(found) == len(want)
        differing = [(a, b) for a, b in zip(found, want) if a[0] != b[0] or abs(a[2] - b[2]) > 2e-6]
        assert not differing, differing[:3]
        assert sum(a[1] != b[1] for a, b in zip(found, want)) <= 0.02 * len(want)  # ties that rounding parts


def test_fewer_rows_than_asked(spark):
    df = frame(spark, [(1, [0.0], "a"), (2, [1.0], "a"), (3, [5.0], "b")])
    assert sorted((r["id"], r["other"]) for r in N.nearest(df, df, 5, "id", "z").collect()) == [(1, 2), (1, 3), (2, 1), (2, 3), (3, 1), (3, 2)]
    assert N.nearest(df.limit(0), df, 2, "id", "z").count() == 0 and N.nearest(df, df.limit(0), 2, "id", "z").count() == 0


def test_clustered_rows_compare_few_pairs(spark):
    n = 6000
    df = frame(spark, [(i, v, "a") for i, v in enumerate(clustered(n, 40, 3))])
    tally = spark.sparkContext.accumulator(0)
    assert N.nearest(df, df, 5, "id", "z", tally=tally).count() == 5 * n
    assert 0 < tally.value < 0.15 * n * n


def test_equal_vectors_compare_few_pairs(spark, monkeypatch):
    """A vector that a third of all rows share costs no more than one row."""
    monkeypatch.setattr(N, "BLOCK", 512)  # less than the rows, so that there are cells
    n = 3000
    z = clustered(n, 20, 4)
    df = frame(spark, [(i, z[0] if i % 3 == 0 else v, "a") for i, v in enumerate(z)])
    tally = spark.sparkContext.accumulator(0)
    found = N.nearest(df, df, 3, "id", "z", tally=tally).where("id % 3 = 0 and id > 8").collect()
    assert {r["other"] for r in found} == {0, 3, 6} and tally.value < 0.2 * n * n


def test_evenly_spread_rows_are_sent_once_to_each_unit(spark, monkeypatch):
    """Where every cell is needed, left rows are not sent to each cell, nor right rows more often than there are units."""
    monkeypatch.setattr(N, "BLOCK", 256)
    monkeypatch.setattr(N, "CELL", 64)
    n, sent, compared = 1500, [], N.compared
    monkeypatch.setattr(N, "compared", lambda a, b, *more: sent.append((a.count(), b.count())) or compared(a, b, *more))
    z = np.random.default_rng(6).normal(size=(n, 24))
    df = frame(spark, [(i, v, "a") for i, v in enumerate(z)])
    found = {}
    for r in N.nearest(df, df, 3, "id", "z").collect():
        found.setdefault(r["id"], []).append((r["distance"], r["other"]))
    gaps = np.round(np.sqrt(((z[:, None] - z[None]) ** 2).sum(2)), 9)
    np.fill_diagonal(gaps, np.inf)
    assert all([o for _, o in sorted(found[i])] == np.lexsort((np.arange(n), gaps[i]))[:3].tolist() for i in range(n))
    assert len(sent) == 2 and all(a <= n and b <= n * -(-n // N.FEWEST) for a, b in sent)


def test_distances_of_near_copies(spark):
    """Rows that differ little are measured by differences, as in SQL: products would lose their distance."""
    v = [3.0, 4.0, 5.0]
    df = frame(spark, [(1, v, "a"), (2, [3.0, 4.0, 5.0 + 4e-9], "a"), (3, [3.0, 4.0 + 7e-9, 5.0], "a"), (4, [float("nan"), 4.0, 5.0], "a")])
    assert sorted(tuple(r) for r in N.nearest(df, df, 1, "id", "z").select("id", "other", "distance").collect()) == [(1, 2, 4e-9), (2, 1, 4e-9), (3, 1, 7e-9)]
