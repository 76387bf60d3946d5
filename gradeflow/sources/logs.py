"""Log files as ordered lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradeflow.functions.text import SPACES
from gradeflow.sources.paths import below, file_path

# Line breaks of Python's str.splitlines() that Spark's text reader keeps inside a line.
INNER_BREAKS = "[\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]"

LINE_RECORD = "run_id string, line_no bigint, ts timestamp, line string, exit_code int"


def run_of_path(path: Column, root: str) -> Column:
    """The file's path below ``root``, or its whole path where it is not below it, without the last suffix.

    Logs of the same name in different folders are different runs.
    """
    inner = F.nullif(F.regexp_extract(path, below(root, "/(.+)$"), 1), F.lit(""))
    return F.regexp_replace(F.coalesce(inner, path), r"\.[^./]*$", "")


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """``run_id, line_no, line`` of all files under ``path``, numbered from 0, undecodable bytes replaced.

    A large log is read in splits. Lines are numbered within a split, which is bounded by the
    split size, and shifted by the line counts of the file's earlier splits.
    """
    text = spark.read.option("recursiveFileLookup", True).text(path).select(
        file_path().alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"),
        F.posexplode(F.split(F.make_valid_utf8("value"), INNER_BREAKS)).alias("_sub", "line"),
    )
    counts = text.groupBy("_file", "_block").agg(F.count("*").alias("_lines"))
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("_file", "_block", F.coalesce(F.sum("_lines").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_file", "_block").orderBy("_at", "_sub")
    return (
        text.withColumn("_row", F.row_number().over(inside))
        .join(shifts, ["_file", "_block"])
        .select(
            run_of_path(F.col("_file"), path).alias("run_id"),
            (F.col("_before") + F.col("_row") - 1).alias("line_no"),
            "line",
        )
    )


def stream_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Appended line records (JSON lines) as a stream, without space at the line ends.

    The record that ends a run has its ``exit_code``.
    """
    return spark.readStream.schema(LINE_RECORD).json(path).withColumn("line", F.rtrim("line", F.lit(SPACES)))
