"""Small fixtures with literal results for the edges of the operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseframe.functions import scalars as S
from pulseframe.hashing import hash_key
from pulseframe.operators import active as A
from pulseframe.operators import balance as B
from pulseframe.operators import clean as C
from pulseframe.operators import metrics as M
from pulseframe.operators import neighbors
from pulseframe.operators import rollups as R
from pulseframe.operators import splits as P
from pulseframe.operators import temporal as T
from pulseframe.operators import vectors as V
from pulseframe.operators import windows as N

MIN, HOUR, DAY = T.MINUTE, T.HOUR, C.DAY


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_asof_takes_equal_times_and_carries_over_days(spark):
    left = spark.createDataFrame([(1, 10), (1, 5), (1, 3 * DAY), (2, 7)], "user_id long, t long")
    right = spark.createDataFrame([(1, 10, 1.0), (1, 6, 2.0), (1, DAY, 3.0)], "user_id long, t long, value double")
    assert got(T.asof_backward(left, right, ["user_id"], {"v": "value"})) == sorted([(1, 5, None), (1, 10, 1.0), (1, 3 * DAY, 3.0), (2, 7, None)], key=repr)


def test_interval_is_closed(spark):
    r = spark.createDataFrame([(1, 1, HOUR)], "reading_id long, user_id long, t long")
    s = spark.createDataFrame([(1, HOUR - 15 * MIN, 1), (1, HOUR + 15 * MIN, 3), (1, HOUR + 15 * MIN + 1, 100)], "user_id long, t long, stress long")
    row = T.interval_join_agg(r, s, "reading_id", "stress").first()
    assert (row["stress_mean"], row["stress_min"], row["stress_max"]) == (2.0, 1.0, 3.0)


def test_minute_rounding_half_even(spark):
    t = spark.createDataFrame([(30_000_000,), (90_000_000,), (29_999_999,)], "t long")
    assert [r[0] for r in t.select(T.round_minute(F.col("t"))).collect()] == [0, 2, 0]


def test_negatives_stay_an_hour_away(spark):
    s = spark.createDataFrame([(1, "hr", m * MIN, 1.0) for m in (0, 240)], "user_id long, data_type string, t long, value double")
    e = spark.createDataFrame([(1, 120 * MIN)], "user_id long, t long")
    minutes = {r["minute"] for r in T.negative_candidates(s, e).collect()}
    assert minutes == set(range(0, 60)) | set(range(181, 241))


def test_label_windows_need_both_signals_and_zero_constants(spark):
    rows = [(1, k, m * MIN, 5.0 if k == "hr" else float(m)) for k in ("hr", "steps") for m in range(0, 300)]
    s = spark.createDataFrame(rows, "user_id long, data_type string, t long, value double")
    labels = spark.createDataFrame([(1, 1, 150 * MIN), (2, 1, 10 * MIN), (3, 2, 150 * MIN)], "reading_id long, user_id long, t long")
    w = N.label_windows(labels, s).collect()
    assert [r["reading_id"] for r in w] == [1]
    assert len(w[0]["hr_seq"]) == 30 and set(w[0]["hr_seq"]) == {0.0}
    assert C.drop_flatline(N.label_windows(labels, s)).count() == 0


def test_sliding_windows_only_full(spark):
    df = spark.createDataFrame([(u, i, float(i)) for u, n in ((1, 46), (2, 29)) for i in range(n)], "user_id long, t long, value double")
    assert [(r["user_id"], r["window_id"], len(r["seq"])) for r in N.sliding_windows(df).orderBy("window_id").collect()] == [(1, 0, 30), (1, 1, 30)]


@pytest.mark.parametrize("scores,auc", [([(1, 0.5), (0, 0.5)], 0.5), ([(1, 0.9), (0, 0.1)], 1.0), ([(1, 0.9)], None), ([(1, 0.2), (1, 0.4), (0, 0.4), (0, 0.3)], 0.375)])
def test_auc_ties_and_single_class(spark, scores, auc):
    df = spark.createDataFrame([(1, y, s) for y, s in scores], "user_id long, y_true long, y_score double")
    assert M.roc_auc(df, ["user_id"]).first()["auc"] == auc
    flipped = M.roc_auc(df.withColumn("y_score", 1 - F.col("y_score")), ["user_id"]).first()["auc"]
    assert flipped == (None if auc is None else pytest.approx(1 - auc))


def test_threshold_defaults_and_literals(spark):
    one = spark.createDataFrame([(1, 1, 2.0)], "user_id long, y_true long, y_score double")
    assert M.select_threshold(one, ["user_id"]).first()["threshold"] == 0.5
    edge = spark.createDataFrame([(1, 1, 0.29), (1, 0, 0.28)], "user_id long, y_true long, y_score double")
    rows = {r["k"]: (r["tp"], r["fp"]) for r in M.confusion_at(edge, ["user_id"]).collect()}
    assert rows[28] == (1, 1) and rows[29] == (1, 0) and rows[30] == (0, 0)


def test_day_split_skips_users_without_a_split(spark):
    days = spark.createDataFrame([(1, d, 10, 5) for d in range(10)] + [(2, 0, 1, 1)], "user_id long, day long, n long, pos long")
    out = P.day_split_retry(days).collect()
    assert {r["user_id"] for r in out} == {1} and len(out) == 10
    assert sum(r["split"] == "test" for r in out) == 2 and sum(r["split"] == "val" for r in out) == 2


def test_exact_sizes_and_disjoint(spark):
    df = spark.createDataFrame([(u, u * 100 + i, i // 5, i % 2) for u in range(3) for i in range(20)], "user_id long, id long, day long, state_val long")
    seed = P.day_class_seed(df, 0.5, 1, "id", by=("user_id", "day"))
    assert seed.count() == 30 and seed.select("id").distinct().count() == 30
    assert P.min_per_user_split(df, 0.2, 1, "id").groupBy("user_id").count().agg(F.min("count")).first()[0] >= 2
    assert got(P.stratified_split(df, 0.3, ["user_id"], 1, "id")) == got(P.stratified_split(df.repartition(7), 0.3, ["user_id"], 1, "id"))


def test_balancing(spark):
    df = spark.createDataFrame([(1, 1, 1), (1, 2, 0), (1, 3, 0), (2, 4, 0), (2, 5, 0), (3, 6, 1), (3, 7, 0)], "user_id long, id long, state_val long")
    c = {r["state_val"]: r["count"] for r in B.undersample_negatives(df, 1, "id").groupBy("state_val").count().collect()}
    assert c == {0: 2, 1: 2}
    c = {r["state_val"]: r["count"] for r in B.oversample_positives(df, 1, "id").groupBy("state_val").count().collect()}
    assert c == {0: 5, 1: 5}
    capped = B.oversample_minority_capped(df, 1, "id", cap=2).where("state_val = 1")
    assert capped.groupBy("user_id").count().agg(F.max("count")).first()[0] == 2  # user 2 has no minority rows, the others hit the cap


def test_packed_values_and_times(spark):
    df = spark.createDataFrame([("Deep: -1, efficiency: 96, start_time: 2024-02-16T01:49:30.000, efficiency: 97", "8/29/2024 12:34"), ("Deep: 14", "NULL")], "v string, q string")
    r = df.select(S.parse_packed(F.col("v")).alias("m"), S.questionnaire_ts(F.col("q")).cast("string").alias("q")).select(S.missing_as_null(F.col("m")["Deep"]), F.col("m")["efficiency"], F.col("m")["start_time"], "q").collect()
    assert tuple(r[0]) == (None, "97", "2024-02-16T01:49:30.000", "2024-08-29 12:34:00") and tuple(r[1]) == (14.0, None, None, None)


def test_wide_table_takes_both_header_variants(spark):
    s = spark.createDataFrame([("hp2", "x", "a", None, None, "0.5 ± 0.1"), ("hp10", "x", "b", 0.7, 0.2, None), ("hp2", "x", "c", 0.9, 0.1, None)], "uid string, pipeline string, path string, auc_mean double, auc_std double, auc_text string").withColumn("auc_train", F.lit(0.9))
    preds = spark.createDataFrame([("x", i % 2, (i * 7 % 10) / 10) for i in range(40)], "pipeline string, y_true long, y_score double")
    wide = {r["uid"]: (r["x_mean"], r["x_std"]) for r in R.sort_by_numeric_id(R.auc_wide_table(s, preds, ["x"]), "uid").collect()}
    assert list(wide) == ["hp2", "hp10", "AGGREGATED"] and wide["hp2"] == (0.5, 0.1)
    assert wide["AGGREGATED"][0] == M.bootstrap_auc(preds, ["pipeline"]).first()["auc_mean"]  # of all predictions together, not a mean over users


def test_strategies_agree_when_the_pool_is_exhausted(spark):
    pool = spark.createDataFrame([(i, float(i % 7) / 7) for i in range(25)], "id long, y_score double")
    by_score = A.active_learning_rounds(pool, pool.limit(0), lambda left, have, r: A.margin_topk(left, 10, "id"), 10, 5, "id")
    assert got(by_score.select("id")) == got(A.random_rounds(pool, 10, 5, 42, "id").select("id"))
    assert by_score.agg(F.max("round")).first()[0] == 3


def test_blocks_do_not_change_neighbours(spark, monkeypatch):
    rows = [(i, [float((i * 37) % 11), float((i * 53) % 13)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, z array<double>")
    whole = got(V.nearest(df, df, 3, "id", "z"))
    monkeypatch.setattr(neighbors, "BLOCK", 7)
    assert got(V.nearest(df, df, 3, "id", "z")) == whole


def test_scaling_and_imputing(spark):
    df = spark.createDataFrame([(1, "1", 5.0), (2, "x", 5.0), (3, "inf", 5.0), (4, "3", 5.0)], "id long, a string, b double")
    out = {r["id"]: (r["a"], r["b"]) for r in C.impute_features(df, df, ["a", "b"]).collect()}
    assert out[2] == (2.0, 5.0) and out[3] == (2.0, 5.0)
    z = C.scale_features(df.select("id", "b"), df.select("id", "b"), ["b"]).collect()
    assert {r["b"] for r in z} == {0.0}


def test_hash_order_is_stable(spark):
    df = spark.range(50)
    assert got(df.select("id", hash_key(1, "id"))) == got(df.repartition(9).select("id", hash_key(1, "id")))


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], "user_id long, y_true long, y_score double, sample_id long")
    assert M.roc_auc(empty, ["user_id"]).count() == 0
    assert M.confusion_at(empty, ["user_id"]).count() == 0
    assert A.margin_topk(empty, 3).count() == 0


def test_readers(spark, tmp_path):
    from pulseframe.sources import readers

    (tmp_path / "hp7").mkdir()
    (tmp_path / "hp7" / "hp7_hr.csv").write_text("datetime_local,bpm\n2024-01-01 00:00:01.5-10:00,60\nbad,61\n2024-01-01 00:00:02,x\n")
    rows = readers.read_signals(spark, str(tmp_path / "hp7")).collect()
    assert [(r["user_id"], r["value"], r["t"] % DAY) for r in rows] == [(7, 60.0, 1_000_000)]
    assert readers.read_self_reports(spark, str(tmp_path / "none"), "melon", "Use").count() == 0
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "a.csv").write_text("a,b\n1,2\nx,3,4\n")
    good, bad = readers.read_csv_guarded(spark, str(tmp_path / "bad"), "a int, b int")
    assert [tuple(r) for r in good.collect()] == [(1, 2)] and bad.count() == 1


@pytest.mark.parametrize("at", [0.0, 9.0])
def test_kmeans_query_starts_from_the_labelled_centroid(spark, at):
    r = np.random.default_rng(4)
    z = np.concatenate([r.normal(c, 0.8, (12, 2)) for c in ((0, 0), (5, 1), (2, 7))])
    lab = np.array([[at, 0.0], [at, 4.0]])
    df = lambda rows: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "id long, z array<double>")
    found = {x["cluster"]: x["id"] for x in V.kmeans_query(df(lab), df(z), 5, "id", "z").collect()}
    far = lambda c: np.linalg.norm(z[:, None] - np.array(c)[None], axis=2)
    centers = [lab.mean(0)]
    while len(centers) < 5:
        centers.append(z[far(centers).min(1).argmax()])
    centers = np.array(centers)
    for _ in range(50):
        own = far(centers).argmin(1)
        centers = np.array([z[own == j].mean(0) if (own == j).any() else c for j, c in enumerate(centers)])
    used = []
    for j in range(5):
        used.append(next(i for i in far(centers)[:, j].argsort() if i not in used))
    assert found == dict(enumerate(used))
    # more centres than rows, and rows that are all alike: every row is picked once
    assert sorted(x["id"] for x in V.kmeans_query(df(lab), df(np.ones((3, 2))), 5, "id", "z").collect()) == [0, 1, 2]


def test_bootstrap_equals_single_draws(spark):
    """Counts by score against rows drawn one by one, whatever the tasks' share of the iterations."""
    r = np.random.default_rng(1)
    rows = [(g, int(r.random() < 0.4), float(round(r.random(), 1))) for g in (1, 2) for _ in range(30 * g)] + [(3, 1, 0.5)]
    df = spark.createDataFrame(rows, "user_id long, y_true long, y_score double")
    found = {x["user_id"]: x for x in M.bootstrap_auc(df, ["user_id"], iterations=200).collect()}
    import hashlib

    for g in (1, 2):
        own = sorted((s, y) for u, y, s in rows if u == g)
        aucs = []
        for i in range(200):
            a, b, c = (int(hashlib.md5(f"42:{g}:{i}".encode()).hexdigest()[x : x + 8], 16) % M.PRIME for x in (0, 8, 16))
            drawn = [own[(pow(a * j + b, 5, M.PRIME) + c) % M.PRIME % len(own)] for j in range(1, round(0.7 * len(own)) + 1)]
            pos, neg = ([s for s, y in drawn if y == v] for v in (1, 0))
            if pos and neg:
                aucs.append(np.mean([(p > q) + (p == q) / 2 for p in pos for q in neg]))
        assert found[g]["auc_mean"] == pytest.approx(np.mean(aucs)) and found[g]["auc_std"] == pytest.approx(np.std(aucs, ddof=1)) and found[g]["valid"] == len(aucs) / 200
    assert found[3]["auc_mean"] is None and found[3]["valid"] == 0


def test_bootstrap_draws_spread_like_random_ones():
    """The generator's deviation of the auc against numpy's own resampling, and its draws against equal chances."""
    r = np.random.default_rng(5)
    y = (r.random(400) < 0.3).astype(int)
    s = np.round(r.normal(y * 0.7, 1), 2)
    scores = np.unique(s)
    pos, neg = (np.array([((s == v) & (y == c)).sum() for v in scores]) for c in (1, 0))
    seeds = r.integers(0, M.PRIME, (3000, 3))
    mine = np.concatenate([M.auc_of(p, q) for _, p, q in M.resampled(scores, pos, neg, seeds, 0.7)])
    order = np.argsort(s, kind="stable")
    at = np.searchsorted(scores, s[order])
    theirs = []
    for _ in range(3000):
        i = order[r.integers(0, 400, 280)]
        cell = np.searchsorted(scores, s[i])
        theirs.append(M.auc_of(np.bincount(cell[y[i] == 1], minlength=len(scores))[None], np.bincount(cell[y[i] == 0], minlength=len(scores))[None])[0])
    assert len(at) == 400 and abs(mine.mean() - np.mean(theirs)) < 0.003 and abs(mine.std() / np.std(theirs) - 1) < 0.06
    drawn = np.bincount(M.draw_rows(seeds, 1, 280, 400).ravel(), minlength=400)
    assert ((drawn - drawn.mean()) ** 2).sum() / drawn.mean() < 500  # chi square with 399 degrees


def test_positions_and_cuts(spark):
    from pulseframe.hashing import first_in_hash_order, with_position

    df = spark.createDataFrame([(i, i % 3, float(i % 7) / 7) for i in range(200)], "id long, g long, y double")
    found = with_position(df, ["g"], -F.floor(F.col("y") * 10), [F.desc("y"), F.col("id")]).collect()
    for g in range(3):
        want = sorted((i for i in range(200) if i % 3 == g), key=lambda i: (-float(i % 7) / 7, i))
        assert [r["id"] for r in sorted((r for r in found if r["g"] == g), key=lambda r: r["_position"])] == want
    assert got(first_in_hash_order(df, 20, 1, "id").select("id")) == got(df.orderBy(hash_key(1, "id"), "id").limit(20).select("id"))
    assert first_in_hash_order(df.limit(0), 5, 1, "id").count() == 0


def test_positions_of_small_and_large_groups(spark, monkeypatch):
    """Groups on both sides of the limit, one with a null key and null buckets; small ones need no table of buckets."""
    from pulseframe import hashing

    rows = [(g, h, i if g != "d" or i % 4 else None, i * 7 % 50) for g, n in (("a", 3), ("b", 30), ("c", 31), ("d", 200), (None, 90)) for h in (1, None) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, h long, y long, id long")
    run = lambda: hashing.with_position(df, ["g", "h"], F.floor(F.col("y") / 2), ["y", "id"], "at")
    small = run()
    whole = got(small)
    final = small._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("Window ") == 1 and "SortMergeJoin" not in final
    monkeypatch.setattr(hashing, "WHOLE", 30)
    assert got(run()) == whole
    for g, h in {(r[0], r[1]) for r in rows}:
        own = sorted((r for r in rows if (r[0], r[1]) == (g, h)), key=lambda r: (r[2] is not None, r[2] or 0, r[3]))
        assert sorted((r[4], r[2], r[3], r[5]) for r in whole if (r[0], r[1]) == (g, h)) == [(i + 1, r[2], r[3], len(own)) for i, r in enumerate(own)]


def test_windows_over_days_equal_those_over_whole_users(spark):
    from pyspark.sql import Window as W

    r = np.random.default_rng(2)
    rows = [(u, int(t), None if r.random() < 0.6 else float(i)) for u in (1, 2) for i, t in enumerate(np.sort(r.integers(0, 9 * DAY, 60)))] + [(3, 5, None), (3, 9 * DAY, None), (4, 1, 2.0)]
    df = spark.createDataFrame(rows, "user_id long, t long, v double")
    w = W.partitionBy("user_id").orderBy("t")
    whole = df.withColumns({"v_lag_1": F.lag("v", 1).over(w), "v_lag_5": F.lag("v", 5).over(w), "sum3": F.when(F.count("v").over(w.rowsBetween(-2, 0)) == 3, F.sum("v").over(w.rowsBetween(-2, 0)))})
    mine = T.rolling_row_stats(T.lag_features(df, ["v"]), "v", (3,))
    assert got(mine.select("user_id", "t", "v_lag_1", "v_lag_5", "v_roll3_sum")) == got(whole.select("user_id", "t", "v_lag_1", "v_lag_5", "sum3"))
    filled = F.coalesce(F.last("v", True).over(w.rowsBetween(W.unboundedPreceding, 0)), F.first("v", True).over(w.rowsBetween(0, W.unboundedFollowing)))
    assert got(T.ffill_bfill(df, ["v"])) == got(df.withColumn("v", filled))


def test_seed_sizes(spark):
    df = spark.createDataFrame([(u, u * 100 + i, i // 5, i % 2) for u in range(3) for i in range(19)], "user_id long, id long, day long, state_val long")
    seed = P.day_class_seed(df, 0.5, 1, "id")
    assert seed.count() == 28 and seed.select("day").distinct().count() == 4  # int(28.5); four days
    with pytest.raises(ValueError):
        P.day_class_seed(df, 0.95, 1, "id", by=("user_id", "day"))
    lone = spark.createDataFrame([(9, i, 0, 1) for i in range(2)] + [(1, 100 + i, 0, int(i == 0)) for i in range(60)], df.schema)
    assert P.target_quota_split(lone, 9, 0.9, 1, "id").where("user_id = 1 AND state_val = 1").count() == 1  # a rare class has one row at least
    days = spark.createDataFrame([(1, d, 0) for d in range(10)], "user_id long, day long, n long")
    assert P.sample_count_day_split(days).where("split = 'train'").count() == 8  # round(7.5), halves to even
    z = spark.createDataFrame([(i, [float(i % 5), float(i // 5)]) for i in range(40)], "id long, z array<double>")
    for method in ("kmeans", "kcenter"):
        assert P.representative_seed(z, 0.85, "id", "z", method).select("id").distinct().count() == 6
