"""Queries that write files from the given tables and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from ..operators import clean as C
from ..registry import query, r6
from ..sources import readers, writers
from ..sources.paths import scratch
from .jobs import experiment_rollup_of, fraction_vs_full, learning_curve
from .q_metrics import boot, rank_sql
from .q_rollups import PIPES, SUMMARIES, predictions, summaries, wide_columns, wide_sql


def text_time(t):
    return F.concat(X.wall_clock(t).cast("string"), F.lit("-10:00"))


@query("a1_read_signals", " SELECT user_id, data_type, t // 1000000 * 1000000 AS t, value FROM signals")
def a1(spark, d):
    """Users' files with three headers: names and order differ, and one has numbers beside the value."""
    out = scratch(spark, "signals")
    rows = X.signals(spark, d).select(text_time(F.col("t")).alias("time"), "data_type", F.col("value").cast("string").alias("value"), F.concat(F.lit("hp"), F.col("user_id").cast("string")).alias("user"), "user_id")
    for i, columns in enumerate((["time as datetime_local", "data_type", "value as bpm"], ["data_type", "value", "time"], ["'7' as quality", "value", "'x' as note", "time", "data_type"])):
        part = rows.where(F.col("user_id") % 3 == i).selectExpr(*columns, "user")
        part.repartition("user").write.mode("append").partitionBy("user").csv(out, header=True)
    return readers.read_signals(spark, out).select("user_id", "data_type", "t", "value")


@query("a4_split_by_type", " SELECT data_type, user_id, t, value FROM signals WHERE data_type IN ('hr', 'sleep')")
def a4(spark, d):
    out = scratch(spark, "types")
    writers.split_by_type(X.signals(spark, d), ("hr", "sleep"), out)
    return spark.read.parquet(out).select("data_type", "user_id", "t", "value")


@query("a5_read_processed", " SELECT user_id, reading_id, CAST(systolic > 130 OR diastolic > 80 AS BIGINT) AS state_val FROM readings")
def a5(spark, d):
    out = scratch(spark, "processed")
    C.spike_label(X.readings(spark, d)).write.parquet(out)
    return readers.read_processed(spark, out).select("user_id", "reading_id", "state_val")


@query("a10_write_grouped", " SELECT regexp_replace(o_orderpriority, '[^A-Za-z0-9_.-]+', '_', 'g') AS grp, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL")
def a10(spark, d):
    out = scratch(spark, "groups")
    writers.write_grouped(X.read(spark, d, "orders").select("o_orderpriority", "o_totalprice"), "o_orderpriority", out)
    return spark.read.csv(out, header=True).groupBy(F.col("_group").alias("grp")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("o_totalprice").cast("double")), 2).alias("total"))


@query("a11_guarded_csv", " SELECT o_orderstatus AS status, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS keys FROM orders WHERE o_orderkey % 10 <> 3 GROUP BY o_orderstatus UNION ALL SELECT 'bad', count(*), NULL FROM orders WHERE o_orderkey % 10 = 3")
def a11(spark, d):
    out = scratch(spark, "lines")
    o = X.read(spark, d, "orders")
    line = F.when(F.col("o_orderkey") % 10 == 3, F.concat(F.lit("x,"), F.col("o_custkey").cast("string"))).otherwise(F.concat_ws(",", "o_orderstatus", F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")))
    o.select(line.alias("value")).write.text(out)
    good, bad = readers.read_csv_guarded(spark, out, "status string, cust long, key long", header=False)
    counts = good.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("cust").alias("keys"))
    return counts.unionByName(bad.agg(F.count(F.lit(1)).alias("n")).select(F.lit("bad").alias("status"), "n", F.lit(None).cast("long").alias("keys")))


@query("a9_run_summaries", " SELECT CAST(s_suppkey AS VARCHAR) AS user, CAST(s_suppkey % 9 + 1 AS DOUBLE) / 10 AS uf, CAST(s_suppkey AS DOUBLE) AS K, CASE WHEN s_suppkey % 2 = 0 THEN 50.0 END AS T FROM supplier")
def a9(spark, d):
    out = scratch(spark, "summaries")
    key = F.col("s_suppkey")
    k = F.when(key % 3 == 0, F.concat(F.lit("["), key.cast("string"), F.lit("]"))).otherwise(key.cast("string"))
    text = F.concat(F.lit('{"user": "'), key.cast("string"), F.lit('", "unlabeled_frac": '), ((key % 9 + 1).cast("double") / 10).cast("string"), F.lit(', "K": '), k, F.lit(', "T": '), F.when(key % 2 == 0, "50").otherwise("null"), F.lit("}"))
    # a run in each file: many tasks write them, and each moves its own into place
    runs = X.read(spark, d, "supplier").repartition(4 * spark.sparkContext.defaultParallelism, key).select(text.alias("value"))
    runs.write.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(out)
    return readers.read_run_summaries(spark, out, "*.txt").select("user", "uf", "K", "T")


@query("a6_result_tree", """, su AS (SELECT o_custkey % 4 AS u, o_orderstatus AS s, count(*) AS n, round(avg(o_totalprice), 2) AS price FROM orders GROUP BY ALL) SELECT 'hp' || u AS uid, s AS substance, 'BP_spike' AS task, n, CASE WHEN u % 2 = 0 THEN price END AS price FROM su""")
def a6(spark, d):
    """Users of even number have a further column, in front."""
    out = scratch(spark, "tree")
    g = X.read(spark, d, "orders").groupBy((F.col("o_custkey") % 4).alias("u"), F.col("o_orderstatus").alias("s")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 2).alias("price")).persist()
    for u in range(4):  # four users' folders
        for s in ("F", "O", "P"):
            g.where((F.col("u") == u) & (F.col("s") == s)).select(*(["n"] if u % 2 else ["price", "n"])).coalesce(1).write.csv(f"{out}/hp{u}/{s}_BP_spike", header=True)
    g.unpersist()
    return readers.read_result_tree(spark, out, "*.csv").select("uid", "substance", "task", F.col("n").cast("long").alias("n"), F.col("price").cast("double").alias("price"))


SCORES = ("auc", "auc_mean", "auc_std")
R_SCORES = ", ".join(f"round({c}, 6) AS {c}" for c in SCORES)


@query("k4_learning_curve", rank_sql("round, split") + boot("round, split", "round || ':' || split") + rank_sql("split", name="f") + boot("split", "split", name="f")
    + f" SELECT rk.round, rk.split, n, round(ap, 6) AS ap, {R_SCORES} FROM rk JOIN bs ON bs.round = rk.round AND bs.split = rk.split UNION ALL SELECT NULL, rkf.split, n, round(ap, 6), {R_SCORES} FROM rkf JOIN bsf ON bsf.split = rkf.split")
def k4(spark, d):
    return learning_curve(X.preds(spark, d)).select("round", "split", "n", *[r6(c).alias(c) for c in ("ap", *SCORES)])


#: The tree's two runs: a result of the second one is newer than that of the first.
ROLLUP = SUMMARIES + """, ru AS (SELECT * REPLACE (run || '/' || substance || '_' || task AS path) FROM (SELECT *, path AS row, CASE WHEN path % 2 = 0 THEN 'run1' ELSE 'run2' END AS run FROM su)),
nw AS (SELECT * FROM ru QUALIFY row_number() OVER (PARTITION BY uid, substance, task, pipeline ORDER BY run DESC, row DESC) = 1)"""


def as_cte(sql: str, name: str) -> str:
    """', x AS (...) SELECT ...' with its last SELECT as one more common table expression."""
    head, last = sql.rsplit("\nSELECT ", 1)
    return f"{head}, {name} AS (SELECT {last}) "


def result_tree(spark, d):
    """The summaries as files <run>/<uid>/<substance>_<task>/...: a run with numbers, then one with texts under another header."""
    out, o = scratch(spark, "results"), summaries(spark, d)
    keys = ["uid", F.concat_ws("_", "substance", "task").alias("folder"), F.col("pipeline").alias("Pipeline"), (F.col("path") % 2).alias("run")]
    o = o.groupBy(*keys).agg(F.max_by(F.struct("auc_train", "auc_mean", "auc_text"), "path").alias("r")).select("uid", "folder", "Pipeline", "run", "r.*")
    train = F.col("auc_train").cast("string").alias("AUC_Train")
    numbers = o.where("run = 0").select("uid", "folder", "Pipeline", train, F.lit("0.5").alias("Best_Threshold"), F.col("auc_mean").cast("string").alias("AUC_Mean"), F.lit("0.01").alias("AUC_STD"))
    texts = o.where("run = 1").select("uid", "folder", F.lit("0.5").alias("AUC_Val"), F.col("auc_text").alias("AUC_Mean ± STD"), "Pipeline", train)
    for run, rows in (("run1", numbers), ("run2", texts)):
        rows.repartition("uid", "folder").write.partitionBy("uid", "folder").csv(f"{out}/{run}", header=True)
    return out


def rollup(spark, d, table):
    return experiment_rollup_of(spark, result_tree(spark, d), predictions(spark, d), PIPES, "*.csv")[table]


@query("k5_experiment_rollup", ROLLUP + wide_sql("", "nw"))
def k5(spark, d):
    return wide_columns(rollup(spark, d, "wide"), [])


@query("k5_grouped", ROLLUP + wide_sql("substance, task", "nw"))
def k5_grouped(spark, d):
    return wide_columns(rollup(spark, d, "grouped"), ["substance", "task"])


@query("k5_long", ROLLUP + as_cte(wide_sql("", "nw"), "wt") + " UNION ALL ".join(f"SELECT uid, '{p}' AS pipeline, mean{p} AS value FROM wt WHERE mean{p} IS NOT NULL" for p in PIPES))
def k5_long(spark, d):
    return rollup(spark, d, "long").select("uid", "pipeline", r6("value").alias("value"))


@query("k6_fraction_vs_full", """, sz AS (SELECT user_id, y_true, count(*) AS n, round(0.1::DOUBLE * count(*), 9) AS share FROM preds GROUP BY user_id, y_true),
qt AS (SELECT user_id, y_true, floor(share) + CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY round(share - floor(share), 9) DESC, y_true) <= floor(round(0.1::DOUBLE * sum(n) OVER (PARTITION BY user_id), 9) + 0.5) - sum(floor(share)) OVER (PARTITION BY user_id) THEN 1 ELSE 0 END AS quota FROM sz),
rr AS (SELECT user_id, y_true, y_score, seed, quota, row_number() OVER (PARTITION BY user_id, y_true, seed ORDER BY md5(seed || ':' || sample_id), sample_id) AS r FROM preds JOIN qt USING (user_id, y_true), (SELECT unnest([42, 43]) AS seed)),
ch AS (SELECT user_id, CAST(seed AS VARCHAR) AS seed, y_true, y_score FROM rr WHERE r <= quota UNION ALL SELECT user_id, 'full_data', y_true, y_score FROM preds)""" + rank_sql("user_id, seed", "ch") + boot("user_id, seed", "user_id || ':' || seed", "ch")
    + """, ll AS (SELECT user_id, seed, avg(-(y_true * ln(p) + (1 - y_true) * ln(1 - p))) AS log_loss FROM (SELECT *, least(greatest(y_score, 1e-15), 1 - 1e-15) AS p FROM ch) GROUP BY user_id, seed)
SELECT rk.user_id, rk.seed, rk.n, round(log_loss, 6) AS log_loss, """ + R_SCORES + " FROM rk JOIN bs ON bs.user_id = rk.user_id AND bs.seed = rk.seed JOIN ll ON ll.user_id = rk.user_id AND ll.seed = rk.seed")  # fmt: skip
def k6(spark, d):
    return fraction_vs_full(X.preds(spark, d), 0.1, (42, 43)).select("user_id", "seed", "n", *[r6(c).alias(c) for c in ("log_loss", *SCORES)])


@query("a2_read_self_reports", """ SELECT scenario, user_id, t // 1000000 * 1000000 AS t FROM self_reports WHERE scenario = 'None' OR substance = 'melon'""")
def a2_files(spark, d):
    """Label files of each scenario, with the time column that the scenario has and two headers, read back for one substance."""
    found = None
    for scenario in ("Crave", "Use", "None"):
        out = scratch(spark, "labels")
        rows = X.self_reports(spark, d).where(F.col("scenario") == scenario)
        time = "hawaii_use_time" if scenario == "Use" else "hawaii_createdat_time"
        rows = rows.select(F.col("event_id").alias("id"), F.col("substance").alias("substance_fruit_label"), "user_id", F.concat(X.wall_clock(F.col("t")).cast("string"), F.lit("-10:00")).alias(time))
        for i, names in enumerate((rows.columns, [time, "user_id", "'x' as crave_use_none_label", "substance_fruit_label"])):
            rows.where(F.col("id") % 2 == i).selectExpr(*names).write.mode("append").csv(out, header=True)
        part = readers.read_self_reports(spark, out, "melon", scenario).select(F.lit(scenario).alias("scenario"), "user_id", "t")
        found = part if found is None else found.unionByName(part)
    return found
