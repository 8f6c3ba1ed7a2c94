"""Readers of signal, label, result and run files; every reader takes a path that only Spark has to open."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import micros
from ..functions.scalars import cut_fraction_ts, participant_id
from .headers import read_by_header


def file_user(path: str = "path") -> Column:
    """The first digits after `hp` in a file's path, as in .../hp12/hp12_hr.csv or .../user=hp12/part-0.csv."""
    return participant_id(F.regexp_extract(F.col(path), r"[/=](hp\d+)[/_.]", 1)).try_cast("long")


#: Columns of signal files that are never the value.
NOT_VALUES = ("time", "datetime_local", "data_type", "user_id", "id", "")


def read_signals(spark: SparkSession, path: str) -> DataFrame:
    """user_id, data_type, t, value of signal files, each read by its own header.

    A file names its time `time` or else `datetime_local`, and its value `value`, or else that is its first other
    column with a number in it. Rows with a bad time or no number are left out, as are files without a time or value.
    """
    table = read_by_header(spark, path)
    rows = table.rows
    own_time = F.when(F.array_contains("header", "time"), table.cell("time")).otherwise(table.cell("datetime_local"))
    if set(table.names) - set(NOT_VALUES) == {"value"}:
        number = table.cell("value").try_cast("double")
    else:
        others = rows.where(~F.array_contains("header", "value")).select("path", F.posexplode(F.arrays_zip("header", "cells")).alias("at", "c"))
        others = others.where(~F.coalesce("c.header", F.lit("")).isin(*NOT_VALUES) & F.col("c.cells").try_cast("double").isNotNull())
        # one row per file without a `value`
        rows = rows.join(others.groupBy("path").agg(F.min("at").alias("at")), "path", "left")
        number = F.coalesce(table.cell("value"), F.get("cells", F.col("at"))).try_cast("double")
    rows = rows.select(file_user().alias("user_id"), table.cell("data_type").alias("data_type"), micros(cut_fraction_ts(own_time)).alias("t"), number.alias("value"))
    return rows.where("t is not null and value is not null")


def read_self_reports(spark: SparkSession, path: str, substance: str, scenario: str) -> DataFrame:
    """user_id, t of label files, each read by its own header; no file or only empty ones give an empty frame.

    `Use` has its own time column, and files without it have no such rows; a scenario None is not filtered by substance.
    """
    try:
        table = read_by_header(spark, path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "user_id long, t long")
    column = "hawaii_use_time" if scenario == "Use" else "hawaii_createdat_time"
    rows = table.named("user_id", "substance_fruit_label", column)
    rows = rows if scenario == "None" else rows.where(F.col("substance_fruit_label") == substance)
    return rows.select(F.col("user_id").try_cast("long").alias("user_id"), micros(cut_fraction_ts(F.col(column))).alias("t")).where("t is not null").orderBy("user_id", "t")


def read_processed(spark: SparkSession, path: str, required: tuple[str, ...] = ("user_id", "BP_spike")) -> DataFrame:
    """A processed feature table with state_val = BP_spike; missing columns are an error."""
    df = spark.read.parquet(path)
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    return df.withColumn("state_val", F.col("BP_spike").cast("long"))


def folders(path: str = "path") -> list[Column]:
    """uid, substance and task from .../<uid>/<substance>_<task>/<file>; folders may be named `key=value`."""
    folder = lambda i: F.substring_index(F.element_at(F.split(F.col(path), "/"), i), "=", -1)
    task = F.split(folder(-2), "_", 2)
    return [folder(-3).alias("uid"), F.get(task, F.lit(0)).alias("substance"), F.get(task, F.lit(1)).alias("task")]


def read_result_tree(spark: SparkSession, root: str, name: str = "comparison_summary.csv") -> DataFrame:
    """All columns of every file `name` below root, as text, with uid, substance and task from the folders and the path.

    Each file is read by its own header; a column that a file does not have is null there.
    """
    table = read_by_header(spark, root, name)
    return table.named(*table.names).select("*", *folders())


def read_summaries(spark: SparkSession, root: str, name: str = "comparison_summary.csv") -> DataFrame:
    """uid, substance, task, pipeline, path, mtime, auc_train, auc_mean, auc_std, auc_text of every result file below root.

    The test auc is a text (`AUC_Mean ± STD`, else `ROC AUC`) or numbers (`AUC_Mean`, `AUC_STD`), as the file has it; a
    text stands before numbers. Rows without a pipeline are left out; spaces in its name become underscores.
    """
    table = read_by_header(spark, root, name)
    cell = lambda c: F.nullif(F.trim(table.cell(c)), F.lit(""))
    text = F.coalesce(cell("AUC_Mean ± STD"), F.when(cell("AUC_Mean").isNull(), cell("ROC AUC")))
    number = lambda c: F.when(text.isNull(), cell(c).try_cast("double"))
    pipeline = F.replace(cell("Pipeline"), F.lit(" "), F.lit("_"))
    rows = table.rows.select(*folders(), pipeline.alias("pipeline"), "path", "mtime", cell("AUC_Train").try_cast("double").alias("auc_train"), number("AUC_Mean").alias("auc_mean"), number("AUC_STD").alias("auc_std"), text.alias("auc_text"))
    return rows.where("pipeline is not null")


def read_run_summaries(spark: SparkSession, root: str, pattern: str = "*.json") -> DataFrame:
    """user, pool, fruit, scenario, uf, T, K, budget of run files; a number may be alone or the first of a list."""
    return parse_run_summaries(spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern))


def parse_run_summaries(raw: DataFrame) -> DataFrame:
    get = lambda k: F.get_json_object("value", f"$.{k}")
    number = lambda k: F.coalesce(get(k).try_cast("double"), F.get_json_object("value", f"$.{k}[0]").try_cast("double"))
    return raw.select(get("user").alias("user"), get("pool").alias("pool"), get("fruit").alias("fruit"), get("scenario").alias("scenario"), number("unlabeled_frac").alias("uf"), number("T").alias("T"), number("K").alias("K"), number("Budget").alias("budget"))


def read_csv_guarded(spark: SparkSession, path: str, schema: str, header: bool = True) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad lines with their files): malformed input of one user does not stop the others.

    With a header, lines that repeat the schema's names are left out. Values do not span lines.
    """
    names = [c.split()[0] for c in schema.split(", ")]
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select("value", F.col("_metadata.file_path").alias("path"))
    if header:
        lines = lines.where(F.col("value") != ",".join(names))
    parsed = F.from_csv("value", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    rows = lines.select("*", parsed.alias("row"))
    return rows.where("row._corrupt_record is null").select(*[F.col(f"row.{n}") for n in names]), rows.where("row._corrupt_record is not null").select("path", F.col("value").alias("line"))
