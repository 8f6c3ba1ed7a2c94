"""CSV files whose headers differ from file to file: each file's cells are found by its own header.

The first line of every file is taken in one pass over the lines (an aggregate by file, so large files are many tasks);
only the distinct headers reach the driver. Lines then meet their file's header by path and are parsed once, whatever
the number of headers. Values do not span lines; blank lines, and lines that repeat the header, are left out. Of columns
with one name the first counts; columns without a name are left out; an empty file has no rows.
"""

from __future__ import annotations

import csv
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Distinct headers below one path; more of them means files without headers.
MOST_HEADERS = 10_000


class Table(NamedTuple):
    """Lines of many files: path, mtime, header (their file's column names), cells (texts in that order)."""

    rows: DataFrame
    #: The names of all headers, in the order in which they are first met.
    names: list[str]

    def named(self, *names: str) -> DataFrame:
        """path, mtime and the named columns as text; null where a file has no such column."""
        return self.rows.select("path", "mtime", *[self.cell(n).alias(n) for n in names])

    @staticmethod
    def cell(name: str) -> Column:
        return F.get("cells", F.array_position("header", F.lit(name)).cast("int") - 1)


def read_by_header(spark: SparkSession, root: str, pattern: str | None = None) -> Table:
    """The lines of all files below root (whose names match pattern) with their own headers."""
    reader = spark.read.option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    meta = {"path": "file_path", "mtime": "file_modification_time", "begin": "file_block_start"}
    lines = reader.text(root).select(F.regexp_replace("value", "^﻿", "").alias("value"), *[F.col(f"_metadata.{c}").alias(n) for n, c in meta.items()])
    lines = lines.where(F.trim("value") != "")
    # a file's first block is read by one task, in order
    first = lines.withColumn("at", F.monotonically_increasing_id()).where("begin = 0").groupBy("path").agg(F.min_by("value", "at").alias("head"))
    heads = [r[0] for r in first.select("head").distinct().limit(MOST_HEADERS + 1).collect()]
    if len(heads) > MOST_HEADERS:
        raise ValueError(f"more than {MOST_HEADERS} different first lines below {root}: files without headers?")
    columns = {h: [c.strip() for c in next(csv.reader([h]))] for h in sorted(heads)}
    width = max(map(len, columns.values()), default=1)
    known = spark.createDataFrame(list(columns.items()), "head string, header array<string>")
    met = lines.join(first.join(known, "head"), "path").where(F.col("value") != F.col("head"))
    cells = F.from_csv("value", ", ".join(f"c{i} string" for i in range(width)))
    rows = met.withColumn("_cells", cells).select("path", "mtime", "header", F.array(*[f"_cells.c{i}" for i in range(width)]).alias("cells"))
    return Table(rows, list(dict.fromkeys(c for names in columns.values() for c in names if c)))
