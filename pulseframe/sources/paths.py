"""Places for what jobs write."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors share; a temporary folder only where it is unset and all runs on this machine."""
    context = spark.sparkContext
    top = context.getConf().get("spark.checkpoint.dir")
    if not top and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not top:
        top = getattr(context, "_scratch_dir", None) or "file://" + tempfile.mkdtemp(prefix="spark-")
        context._scratch_dir = top
    return top.rstrip("/")


def checkpoints(spark: SparkSession) -> None:
    """Let df.checkpoint() write below the shared folder."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared(spark))


def scratch(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing has used before."""
    return f"{shared(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, so that it is made once and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
