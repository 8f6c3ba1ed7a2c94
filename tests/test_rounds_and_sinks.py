"""Rounds that go on where a killed run stopped, and sinks that replace or refuse."""

import pytest
from pyspark.sql import functions as F

from pulseframe.operators import active as A
from pulseframe.operators import clean as C
from pulseframe.sources import writers


def pool_of(spark):
    return spark.createDataFrame([(i, float((i * 37) % 101)) for i in range(60)], "id long, x double")


def scorer(rows):
    mean = rows.where("queried_round is not null").agg(F.avg("x").alias("m"))
    return rows.crossJoin(mean).withColumn("score", -F.abs(F.col("x") - F.col("m")))


def test_a_killed_run_goes_on(spark, tmp_path):
    pool, labeled = pool_of(spark), pool_of(spark).where("id < 3")
    pick = A.score_picks("score", 4, "id")
    whole = sorted(tuple(r) for r in A.active_learning_rounds(pool, labeled, pick, 4, 4, "id", f"file://{tmp_path}/whole", scorer).collect())
    assert len(whole) == 16 and len({i for i, _ in whole}) == 16
    calls = []

    def dies(left, have, r):
        calls.append(r)
        if r == 2 and calls.count(2) == 1:
            raise RuntimeError("killed")
        return pick(left, have, r)

    state = f"file://{tmp_path}/state"
    with pytest.raises(RuntimeError, match="killed"):
        A.active_learning_rounds(pool, labeled, dies, 4, 4, "id", state, scorer)
    (tmp_path / "state" / "000002").mkdir()
    (tmp_path / "state" / "000002" / "part-half.parquet").write_text("not whole")  # of the round that was lost
    assert A.rounds_done(spark, state) == 1
    again = sorted(tuple(r) for r in A.active_learning_rounds(pool, labeled, dies, 4, 4, "id", state, scorer).collect())
    assert again == whole and calls == [1, 2, 2, 3, 4]
    assert sorted(tuple(r) for r in A.active_learning_rounds(pool, labeled, dies, 4, 4, "id", state, scorer).collect()) == whole and len(calls) == 5
    few = A.active_learning_rounds(pool, labeled, dies, 4, 2, "id", state, scorer)
    assert few.agg(F.max("round")).first()[0] == 2


def test_rounds_end_with_the_pool(spark, tmp_path):
    pool = pool_of(spark).where("id < 10")
    out = A.active_learning_rounds(pool, pool.where("id < 3"), A.score_picks("score", 4, "id"), 4, 9, "id", f"file://{tmp_path}/s", scorer)
    assert out.count() == 7 and out.agg(F.max("round")).first()[0] == 2
    again = A.active_learning_rounds(pool, pool.where("id < 3"), A.score_picks("score", 4, "id"), 4, 9, "id", f"file://{tmp_path}/s", scorer)
    assert again.count() == 7


def test_replacing_users(spark, tmp_path):
    out = f"file://{tmp_path}/users"
    writers.replace_users(spark.createDataFrame([(1, 10), (1, 11), (2, 20), (None, 5)], "user_id long, v long"), out)
    new = spark.createDataFrame([(1, "b", 12), (3, "b", 30)], "user_id long, run string, v long")
    for _ in range(2):
        writers.replace_users(new, out)
    got = sorted(((r["user_id"], r["run"], r["v"]) for r in writers.read_users(spark, out).collect()), key=repr)
    assert got == [(1, "b", 12), (2, None, 20), (3, "b", 30), (None, None, 5)]


def test_splits_refuse_overlapping_days(spark, tmp_path):
    rows = [(1, 5, "train", 1), (1, 5, "train", 2), (1, 6, "test", 3), (2, 6, "val", 4)]
    frame = lambda r: spark.createDataFrame(r, "user_id long, day long, split string, id long")
    prints = writers.write_splits(frame(rows), f"file://{tmp_path}/ok", F.concat_ws("|", "user_id", "id")).collect()
    assert {(r["user_id"], r["split"]): r["rows"] for r in prints} == {(1, "train"): 2, (1, "test"): 1, (2, "val"): 1}
    assert spark.read.parquet(f"file://{tmp_path}/ok/windows").where("split = 'train'").count() == 2
    with pytest.raises(ValueError, match="1 5"):
        writers.write_splits(frame([*rows, (1, 5, "test", 9)]), f"file://{tmp_path}/bad", F.col("id").cast("string"))
    assert not (tmp_path / "bad").exists()
    assert C.DAY


def test_run_files_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    """A run in each file, and no single task (nor the driver, one after the other) writes them all."""
    from pulseframe.plans import q_sources

    monkeypatch.setattr(q_sources, "scratch", lambda spark, name: f"file://{tmp_path}/{name}")
    found = q_sources.a9(spark, "/root/testdata/sf0.01")
    files = [p.name for p in tmp_path.rglob("part-*.txt")]
    assert found.count() == len(files) == spark.read.parquet("/root/testdata/sf0.01/supplier.parquet").count()
    assert len({f.split("-")[1] for f in files}) > 8
