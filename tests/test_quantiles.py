"""Exact quantiles against Spark's percentile, on friendly and unfriendly columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseframe.operators import quantiles as Q

FRACTIONS = [0.0, 0.1, 0.25, 0.5, 0.731, 0.9, 0.999, 1.0]


@pytest.mark.parametrize("keep", [4096, 5])
def test_equal_percentile(spark, monkeypatch, keep):
    monkeypatch.setattr(Q, "KEEP", keep)
    r = np.random.default_rng(1)
    n = 3001
    columns = {
        "even": r.random(n), "wide": 10.0 ** r.uniform(-300, 300, n) * r.choice((-1, 1), n), "ties": r.choice((1.0, 2.0, 2.0, 2.0, 3.0), n), "one": np.full(n, 7.5),
        "mass": np.where(r.random(n) < 0.6, 0.0, r.normal(0, 1e-9, n)), "holes": np.where(r.random(n) < 0.3, np.nan, r.normal(0, 1, n)),
    }
    rows = [[None if x != x else float(x) for x in row] for row in zip(*columns.values())]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns)).repartition(5).cache()
    found = Q.exact_quantiles(df, {c: (F.col(c), FRACTIONS) for c in columns})
    want = df.agg(*[F.percentile(c, FRACTIONS).alias(c) for c in columns]).first()
    for c in columns:
        assert found[c] == pytest.approx(want[c], rel=1e-12, abs=0), c
        assert found[c][0] == want[c][0] and found[c][-1] == want[c][-1]
    df.unpersist()


def test_whatever_the_sketch_says(spark, monkeypatch):
    """A bad sketch costs rounds, not exactness, and no more than KEEP values are gathered."""
    monkeypatch.setattr(Q, "KEEP", 8)
    monkeypatch.setattr(Q, "ACCURACY", 5)
    monkeypatch.setattr(Q, "MARGIN", 0.2)
    lists = []
    plain = F.collect_list
    monkeypatch.setattr(Q.F, "collect_list", lambda c: lists.append(c) or plain(c))
    df = spark.range(5000).select(((F.col("id") * 7919) % 5000).cast("double").alias("x"))
    targets = [Q.Target(F.col("x"), k, 5000) for k in (0, 1, 17, 2500, 4998, 4999)]
    Q.order_statistics(df, targets)
    assert [t.value for t in targets] == [0.0, 1.0, 17.0, 2500.0, 4998.0, 4999.0] and all(t.n <= 5000 for t in targets)
    assert all(t.n <= 8 for t in targets[: len(lists)] if len(lists) == len(targets))


def test_without_values(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert Q.exact_quantiles(df, {"a": (F.col("x"), [0.5, 1.0])}) == {"a": [None, None]}
    assert Q.exact_quantiles(df.limit(0), {"a": (F.col("x"), [0.5])}) == {"a": [None]}
