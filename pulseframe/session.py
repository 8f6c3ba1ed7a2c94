"""Sessions as the jobs expect them: UTC, adaptive plans, Arrow for the few Python kernels."""

from pyspark.sql import SparkSession


def session(master: str = "local[*]", shuffle_partitions: int = 8, **more: str) -> SparkSession:
    conf = {
        "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.ui.enabled": "false",
    } | more
    return SparkSession.builder.master(master).config(map=conf).getOrCreate()
