"""Landed lines that can't be used, kept beside those that can.

A damaged line does not end the job and does not vanish: it goes to a rejects table with its file
and the reason, and a budget says from how many on the input as a whole is not to be trusted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from forgeline.session import new_run_folder
from forgeline.sources.tables import _unless_missing

REJECTS = "kind STRING, reason STRING, file STRING, record STRING"
NOT_JSON, WRONG_TYPE, NO_KEY, NO_DETAIL = "not JSON", "wrong type", "no key", "no detail"


class TooManyRejects(RuntimeError):
    """The rejects of an input are beyond its budget."""


@dataclass(frozen=True)
class Budget:
    """Rejects that an input may have: a share of its rows, or ``least`` if that is more."""

    share: float = 0.001
    least: int = 10

    def check(self, kind: str, rejected: int, total: int) -> None:
        if rejected > max(self.least, self.share * total):
            raise TooManyRejects(f"{kind}: {rejected} of {total} rows are rejected")


def read_with_rejects(
    spark: SparkSession, path: str, schema: str, kind: str, required: list[str] = [], budget: Budget | None = None
) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of JSON lines, read once.

    Rejected are lines that are not JSON, whose values don't fit the schema, or that lack a required
    column. Both sides are written in the same pass, partitioned by which it is, and counted on the
    way; beyond the budget the call raises. Blank lines are skipped, a missing path is empty.
    """
    full = f"{schema}, _line STRING"
    reader = spark.read.schema(full).options(mode="PERMISSIVE", columnNameOfCorruptRecord="_line")
    lines = _unless_missing(
        lambda: reader.json(path).withColumn("_file", F.col("_metadata.file_path")), spark, f"{full}, _file STRING"
    )
    columns = [c for c in lines.columns if c not in ("_line", "_file")]
    lacking = F.lit(False)
    for name in required:
        lacking |= F.col(name).isNull()
    reason = (
        F.when(F.col("_line").isNotNull(), F.when(F.try_parse_json("_line").isNull(), NOT_JSON).otherwise(WRONG_TYPE))
        .when(lacking, NO_KEY)
        .alias("_reason")
    )
    record = F.when(lacking & F.col("_line").isNull(), F.to_json(F.struct(*columns))).otherwise(F.col("_line"))
    tagged = lines.select(*columns, "_file", reason, record.alias("_record"))
    counts = Observation(f"landed-{kind}")
    folder = new_run_folder(spark, f"landed-{kind}")
    (
        tagged.withColumn("_rejected", F.col("_reason").isNotNull())
        .observe(counts, F.count(F.lit(1)).alias("total"), F.count("_reason").alias("rejected"))
        .write.partitionBy("_rejected")
        .parquet(folder)
    )
    if budget is not None:
        found = counts.get
        budget.check(kind, found["rejected"] or 0, found["total"] or 0)
    stored = _unless_missing(
        lambda: spark.read.schema(f"{schema}, _file STRING, _reason STRING, _record STRING, _rejected BOOLEAN").parquet(folder),
        spark,
        f"{schema}, _file STRING, _reason STRING, _record STRING, _rejected BOOLEAN",
    )
    rejected = stored.filter("_rejected").select(
        F.lit(kind).alias("kind"), F.col("_reason").alias("reason"), F.col("_file").alias("file"), F.col("_record").alias("record")
    )
    return stored.filter("NOT _rejected").select(*columns), rejected


def missing_details(listing: DataFrame, details: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """Listed records whose detail did not arrive, as rejects: their keys as JSON."""
    absent = listing.select(*keys).distinct().join(details.select(*keys), keys, "left_anti")
    return absent.select(
        F.lit(kind).alias("kind"),
        F.lit(NO_DETAIL).alias("reason"),
        F.lit(None).cast("string").alias("file"),
        F.to_json(F.struct(*keys)).alias("record"),
    )


def write_rejects(rejects: DataFrame, root: str, run: str) -> None:
    """Store the rejects of one kind and run; a run that is repeated replaces its own."""
    (
        rejects.withColumn("run", F.lit(run))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run", "kind")
        .parquet(f"{root}/rejects")
    )


def read_rejects(spark: SparkSession, root: str) -> DataFrame:
    full = f"{REJECTS}, run STRING"
    return _unless_missing(lambda: spark.read.schema(full).parquet(f"{root}/rejects"), spark, full)
