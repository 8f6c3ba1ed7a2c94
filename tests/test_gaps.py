"""Quiet minutes by sweeping events, against a loop over all minutes."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from pulseframe.operators import temporal as T

M = T.MINUTE


def brute(signals, events, half):
    out = set()
    for u in {s[0] for s in signals if s[1] == "hr"}:
        own = [s[2] for s in signals if s[0] == u and s[1] == "hr"]
        for t in range(min(own), max(own) + 1, M):
            minute, rest = divmod(t, M)
            minute += rest * 2 > M or rest * 2 == M and minute % 2 == 1
            if not any(e[0] == u and abs(e[1] - minute * M) <= half for e in events):
                out.add((u, minute))
    return out


@pytest.mark.parametrize("seed, offset", [(1, 0), (2, M // 2), (3, 17_000_001), (4, M - 1)])
def test_equal_a_loop_over_minutes(spark, seed, offset):
    r = random.Random(seed)
    signals = [(u, k, offset + (u * 700 + m) * M, 1.0) for u in range(4) for k in ("hr", "steps") for m in [0] + r.sample(range(4000), 20)] + [(9, "steps", 0, 1.0), (8, "hr", offset + 5 * M, 1.0)]
    events = [(u, r.randrange(-100, 6000) * M + r.choice((0, 1, M // 2, 59_999_999))) for u in range(4) for _ in range(12)] + [(1, 100 * M)] * 40 + [(7, 5)]
    s = spark.createDataFrame(signals, "user_id long, data_type string, t long, value double")
    e = spark.createDataFrame(events, "user_id long, t long")
    for half in (T.HOUR, 90_000_000, 0):
        found = [tuple(x) for x in T.negative_candidates(s, e, half).collect()]
        assert len(found) == len(set(found)) and set(found) == brute(signals, events, half)
    gaps = T.negative_gaps(s, e)
    wanted = spark.createDataFrame([(0, 25), (1, 0), (2, 100_000), (3, 1), (5, 3)], "user_id long, n long")
    got = {}
    for u, minute in T.sample_minutes(gaps, wanted, 42).collect():
        got.setdefault(u, set()).add(minute)
    every = brute(signals, events, T.HOUR)
    for u, n in ((0, 25), (2, 100_000), (3, 1)):
        order = sorted((hashlib.md5(f"42:{u}:{m}".encode()).hexdigest(), m) for v, m in every if v == u)
        assert got[u] == {m for _, m in order[:n]}
    assert set(got) == {0, 2, 3}


def test_runs_are_few_and_travel_instead_of_minutes(spark):
    """A day with one event is one or two runs; sampling sends on little more than what it takes."""
    day = 1440
    s = spark.createDataFrame([(u, "hr", m * M, 1.0) for u in range(3) for m in (0, 30 * day)], "user_id long, data_type string, t long, value double")
    e = spark.createDataFrame([(u, d * day * M) for u in range(3) for d in range(30)], "user_id long, t long")
    gaps = T.negative_gaps(s, e)
    assert gaps.count() <= 3 * 31 * 2 < T.minutes_of(gaps).count() / 100
    found = T.sample_minutes(gaps, spark.createDataFrame([(u, 50) for u in range(3)], "user_id long, n long"), 42)
    assert found.groupBy("user_id").count().where("count = 50").count() == 3


def test_label_windows_look_up_each_grid_point_once(spark, monkeypatch):
    """Two hundred labels in an hour ask for the minutes around that hour, not for two hours of minutes each."""
    from pulseframe.operators import windows as N

    asked, kept = [], N.asof_backward
    monkeypatch.setattr(N, "asof_backward", lambda left, *a, **b: asked.append(left.count()) or kept(left, *a, **b))
    minute = 60_000_000
    signals = spark.createDataFrame([(1, kind, m * minute, float((m * k) % 17)) for k, kind in ((7, "hr"), (5, "steps")) for m in range(600)], "user_id long, data_type string, t long, value double")
    labels = spark.createDataFrame([(i, 1, 300 * minute + i * minute // 4) for i in range(200)], "reading_id long, user_id long, t long")
    got = {r["reading_id"]: r for r in N.label_windows(labels, signals).collect()}
    assert len(got) == 200 and asked[0] <= 2 * 180
    for i in (0, 1, 77, 199):
        t = 300 * minute + i * minute // 4
        raw = {}
        for m in range(600):
            if abs(m * minute - t) <= 60 * minute:
                raw.setdefault(m // 4, []).append(float((m * 7) % 17))
        v = [sum(x) / len(x) for _, x in sorted(raw.items())][:30]
        mean = sum(v) / 30
        sd = (sum((x - mean) ** 2 for x in v) / 30) ** 0.5
        assert max(abs(a - (x - mean) / sd) for a, x in zip(got[i]["hr_seq"], v, strict=True)) < 1e-9
