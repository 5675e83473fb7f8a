"""Numbers of lines in the order of files and lines, as if all files were one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from forgeline.sources.tables import _unless_missing, settle


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, file, value): text lines numbered from 0; files in the order of their paths.

    A task reads a stretch of a file in order, so a line's number is the count of lines in the
    stretches before it, a table of one row a stretch, and its place in its own. Lines are neither
    sorted nor gathered. Blank lines have no number and are left out; a missing path is empty.
    """
    empty = "value STRING, file STRING, start BIGINT, place BIGINT"
    lines = _unless_missing(
        lambda: spark.read.text(path).select(
            "value",
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("start"),
            F.monotonically_increasing_id().alias("place"),
        ),
        spark,
        empty,
    )
    # Written once: a stretch and a place are only comparable within one reading of the files.
    read = settle(lines.filter(F.length(F.trim("value")) > 0), "lines")
    # Places within a stretch have gaps where blank lines were, so they are ranked by stretch and task.
    stretches = read.groupBy("file", "start").agg(F.count("*").alias("n"))
    before = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stretches.select("file", "start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("file", "start").orderBy("place")) - 1
    placed = read.withColumn("within", within).join(offsets, ["file", "start"])
    return placed.select((F.col("offset") + F.col("within")).alias("ordinal"), "file", "value")


def numbered_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with their ordinal; one that is not JSON keeps its number and has null columns."""
    row = F.from_json("value", schema).alias("row")
    return numbered_lines(spark, path).select("ordinal", row).select("ordinal", "row.*")
