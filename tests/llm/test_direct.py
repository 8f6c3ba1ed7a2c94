"""Operators against direct, slow versions of themselves on a few rows."""

import math
import random

import numpy as np
import pytest

from pulseframe.llm import mixing, packing
from tests.llm.test_operators import docs_of, words


def test_dual_equals_bisection(spark):
    """A dozen documents and more in four sources: each source's lambda by plain bisection."""
    r = random.Random(3)
    rows = [(i, words(r.choice((2, 9, 40, 160)), i), "abc"[i % 3] if i % 7 else None) for i in range(40)]
    found = {x["source"]: x for x in mixing.mix(docs_of(spark, rows)).select("source", "target", "source_size").distinct().collect()}
    sizes = {}
    for _, t, s in rows:
        sizes.setdefault(s, []).append(len(t.split()))
    classes = spark.createDataFrame([(s, z, n) for s, own in sizes.items() for z in set(own) for n in [own.count(z)]], "source string, size long, n long")
    targets = spark.createDataFrame([(s, x["source_size"], x["target"]) for s, x in found.items()], "source string, source_size long, target double")
    dual = {x["source"]: x for x in mixing.solve_dual(classes, targets, 3.0).collect()}
    for s, own in sizes.items():
        mean = sum(own) / len(own)
        got = lambda lam: sum(z * min(3.0, math.exp(min(lam * z / mean, 50.0))) for z in own)  # noqa: E731,B023
        low, high = -60.0 * mean / min(own), 60.0 * mean / min(own)
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if got(mid) < found[s]["target"] else (low, mid)
        assert got(dual[s]["lam"]) == pytest.approx(found[s]["target"], rel=1e-6)
        if found[s]["target"] < 3 * sum(own) * (1 - 1e-9):
            assert dual[s]["lam"] == pytest.approx(low, abs=1e-6)


def one_by_one(demand, limits):
    """The dot-product heuristic a piece at a time; the kinds of each sequence, in the order they were placed."""
    kinds, of = np.unique(demand, axis=0, return_inverse=True)
    left = np.bincount(of.reshape(-1), minlength=len(kinds))
    most, out = np.maximum(limits, 1).astype(float), []
    while left.any():
        room, own = limits.copy(), []
        while True:
            fits = (left > 0) & (kinds <= room).all(axis=1)
            if not fits.any():
                break
            score = np.where(fits, (kinds / most) @ (room / most), -1.0)
            best = int(score.argmax())
            own.append(tuple(kinds[best]))
            left[best] -= 1
            room = room - kinds[best]
        out.append(own)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_packing_equals_one_by_one(seed):
    r = np.random.default_rng(seed)
    demand = np.stack((r.integers(1, 60, 120), r.integers(1, 4, 120), r.integers(0, 40, 120)), axis=1)
    limits = np.array([100, 8, 64])
    sequence, offset = packing.fill(demand, limits)
    mine = [[tuple(demand[i]) for i in sorted(np.flatnonzero(sequence == s), key=lambda i: offset[i])] for s in np.unique(sequence)]
    assert sorted(mine) == sorted(one_by_one(demand, limits))
