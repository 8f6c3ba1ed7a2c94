"""Exact deduplication by a stream over keyed state on disk. DataFrame operations only.

Each arriving row is a digest, a stable identifier and a content locator (file and row in it). A streaming
aggregation keeps, per digest and without expiry, the winning identifier with its locator and the number of arrivals
in RocksDB state below the shared checkpoint folder. Rows that hit a digest seen before are then compared with the
full bytes of the winner, the row at its locator; rows that share the digest but not the bytes form groups of their own.
The texts of hits are fetched in one pass over all texts, and winners are found among them by their locators.

Defined cases: null text counts as empty; a repeated row counts as one more copy; a null identifier loses against
any other and is not compared byte by byte; an empty table gives an empty result; columns beyond id and text are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, new_path, shared_dir, staged, table

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Copies that one replica of a winner's text is compared with.
COPIES_PER_REPLICA = 256


def sha256_text(text: Column) -> Column:
    return F.sha2(text, 256)


def run_state(arrivals: DataFrame, checkpoint: str) -> None:
    """Drain a stream of (digest, doc_id, locator) into keyed state below checkpoint; a later call carries on there."""
    spark = arrivals.sparkSession
    wanted = {
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        "spark.sql.streaming.stateStore.unloadOnCommit": "true",  # else each open partition holds 4 MB of local disk
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "100",
        "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "8",
    }
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        state = arrivals.groupBy("digest").agg(F.max(F.struct("doc_id", "locator")).alias("keep"), F.count(F.lit(1)).alias("n"))
        query = state.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def read_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """digest, keep_id, locator, n: what the state under checkpoint holds."""
    held = spark.read.format("statestore").load(checkpoint)
    return held.select(
        F.col("key.digest").alias("digest"), F.col("value.max.doc_id").alias("keep_id"),
        F.col("value.max.locator").alias("locator"), F.col("value.count").alias("n"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256_text) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, digest, locator (of the row that stays).

    The largest id of equal texts stays. `digest` may be any function of the text; equal digests of different
    bytes are told apart.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    wanted = [F.col(id_col).cast("long").alias("doc_id"), text.alias("text")]
    place = F.concat_ws("#", "_metadata.file_path", "_metadata.row_index").alias("locator")
    try:
        rows = docs.select(*wanted, place)
    except AnalysisException:  # not the rows of files: they are written, and found there
        rows = staged(docs.select(*wanted), "texts").select("doc_id", "text", place)
    rows = rows.withColumn("digest", digest(F.col("text")))
    arrivals = staged(rows.select("digest", "doc_id", "locator"), "arrivals")
    if not arrivals.inputFiles():
        return arrivals.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest", "locator")
    checkpoint = new_path(spark, "dedup-state")
    run_state(spark.readStream.schema(arrivals.schema).parquet(arrivals.inputFiles()[0].rsplit("/", 1)[0]), checkpoint)
    state = staged(read_state(spark, checkpoint), "dedup-groups")
    ids = arrivals.select("doc_id", "digest").join(state, "digest")

    # full bytes, of hits only, fetched in one pass over the texts; their winners are the rows at the state's locators.
    # the join is by sorting at every size: broadcasting some hits would only change the plan as tables grow
    # dealt by id before rows are made distinct, else a frequent digest's rows would meet in one task for that
    hits = staged(ids.where("n > 1").select("doc_id", "digest", "keep_id", F.col("locator").alias("keep_locator"), "n").repartition("doc_id").distinct(), "hits")
    met = rows.select("doc_id", "digest", "text", "locator").join(hits.hint("merge"), ["doc_id", "digest"])
    texts = staged(met.select("doc_id", "digest", "text", "n", ((F.col("locator") == F.col("keep_locator")) & F.col("keep_id").isNotNull()).alias("keeps")), "hit-texts")
    # members meet replicas of the winner, so that no group meets in one task
    replicas = F.ceil(F.col("n") / COPIES_PER_REPLICA).cast("int")
    members = texts.withColumn("part", F.pmod(F.xxhash64("doc_id"), replicas).cast("int"))
    winners = texts.where("keeps").select("digest", F.col("text").alias("keep_text"), F.explode(F.sequence(F.lit(0), replicas - 1)).alias("part"))
    odd = staged(members.join(winners, ["digest", "part"]).where("text != keep_text").select("doc_id", "digest", "text"), "dedup-collisions")

    out = ids.select("doc_id", "keep_id", F.col("n").alias("group_size"), "digest", "locator")
    if not odd.isEmpty():
        own = odd.groupBy("digest", "text").agg(F.max("doc_id").alias("own_keep"), F.count(F.lit(1)).alias("own_n"))
        own_rows = odd.join(own, ["digest", "text"]).select("doc_id", "digest", "own_keep", "own_n").dropDuplicates(["doc_id", "digest"])
        lost = odd.groupBy("digest").agg(F.count(F.lit(1)).alias("lost"))
        out = out.join(own_rows, ["doc_id", "digest"], "left").join(lost, "digest", "left")
        out = out.select(
            "doc_id", F.coalesce("own_keep", "keep_id").alias("keep_id"),
            F.coalesce("own_n", F.col("group_size") - F.coalesce("lost", F.lit(0))).alias("group_size"), "digest", "locator",
        )
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each text, that of the largest id, with the columns of docs. Of rows with one id and text one stays."""
    keys = exact_dedup(docs, id_col, text_col).where("kept").select(F.coalesce("doc_id", F.lit(0)).alias("_keep_id"), F.col("doc_id").isNull().alias("_keep_null"), F.col("digest").alias("_keep_digest"))
    own = ["id", "null", "digest"]
    names = [free_name(docs, f"_own_{x}") for x in own]
    key = F.col(id_col).cast("long")
    rows = docs.withColumns(dict(zip(names, (F.coalesce(key, F.lit(0)), key.isNull(), sha256_text(F.coalesce(F.col(text_col).cast("string"), F.lit("")))), strict=True)))
    same = [rows[n] == keys[f"_keep_{x}"] for n, x in zip(names, own, strict=True)]
    return rows.join(keys, reduce(lambda a, b: a & b, same), "left_semi").dropDuplicates(names).select(*docs.columns)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared_dir(spark)
    found = exact_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP1_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
