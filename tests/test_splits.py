"""Largest remainders and stratified validation days."""

import numpy as np
import pytest

from pulseframe.operators import splits as P


@pytest.mark.parametrize("frac", [0.0, 0.1, 0.25, 1 / 3, 0.5, 0.77, 1.0])
def test_totals_are_exact(spark, frac):
    r = np.random.default_rng(1)
    rows = [(i, int(u), int(y)) for i, (u, y) in enumerate(zip(r.integers(0, 40, 500), r.random(500) < 0.3))] + [(1000 + i, None, 1) for i in range(7)]
    df = spark.createDataFrame(rows, "id long, user_id long, y long")
    want = int(np.floor(round(frac * len(rows), 9) + 0.5))
    s = P.stratified_split(df, frac, ["user_id", "y"], 1, "id").collect()
    assert len(s) == len(rows) and sum(x["chosen"] for x in s) == want
    sizes, chosen = {}, {}
    for x in s:
        k = (x["user_id"], x["y"])
        sizes[k], chosen[k] = sizes.get(k, 0) + 1, chosen.get(k, 0) + x["chosen"]
    assert all(abs(chosen[k] - frac * n) < 1 for k, n in sizes.items())
    per_user = P.stratified_split(df, frac, ["user_id", "y"], 1, "id", within=["user_id"]).where("user_id is not null").groupBy("user_id").agg({"chosen": "count", "id": "count"})
    assert per_user.count() == 40
    assert P.stratified_split(df, frac, [], 1, "id").where("chosen").count() == want


def brute_val(days, n_val):
    """days: (rank, n) of the rest, in order. The validation days' ranks by class, or None if classes do not fit."""
    by = {}
    for rank, n in days:
        by.setdefault(n, []).append(rank)
    m = len(days)
    if min(map(len, by.values())) < 2 or n_val < len(by) or m - n_val < len(by):
        return None
    quota = {n: n_val * len(v) // m for n, v in by.items()}
    for n in sorted(by, key=lambda n: (-(n_val * len(by[n]) % m), n))[: n_val - sum(quota.values())]:
        quota[n] += 1
    return {r for n, v in by.items() for r in v[: quota[n]]}


@pytest.mark.parametrize("seed", range(3))
def test_validation_days_by_windows(spark, seed):
    import hashlib

    r = np.random.default_rng(seed)
    days = [(u, d, int(r.choice((6, 8)) if u % 2 else r.integers(4, 30)), 3) for u in range(8) for d in range(int(r.integers(12, 40)))]
    out = {(x["user_id"], x["day"]): x["split"] for x in P.day_split_retry(spark.createDataFrame(days, "user_id long, day long, n long, pos long"), seed).collect()}
    stratified = 0
    for u in range(8):
        own = sorted((hashlib.md5(f"{seed}:{u}:{d}".encode()).hexdigest(), d, n) for v, d, n, _ in days if v == u)
        test = [d for _, d, _ in own if out[u, d] == "test"]
        assert [d for _, d, _ in own[: len(test)]] == test
        rest = [(d, n) for _, d, n in own[len(test) :]]
        n_val = -(-len(rest) // 4)
        want = brute_val(rest, n_val)
        stratified += want is not None
        assert {d for d, _ in rest if out[u, d] == "val"} == (want or {d for d, _ in rest[:n_val]})
    assert stratified >= 4


def test_skipped_users(spark):
    days = spark.createDataFrame([(1, d, 10, 5) for d in range(10)] + [(2, 0, 1, 1), (3, 0, 9, 9), (3, 1, 9, 9), (4, 0, 50, 20)], "user_id long, day long, n long, pos long")
    split = P.day_split_retry(days)
    assert {x["user_id"]: (x["days"], x["windows"], x["positives"], x["reason"]) for x in P.skipped_users(days, split).collect()} == {
        2: (1, 1, 1, "too few windows"), 3: (2, 18, 18, "too few of a class"), 4: (1, 50, 20, "no size fits"),
    }
