"""Review decisions as a change log with snapshots.

A decision is appended as a change. Readers take the last snapshot and the changes after it, and
the last decision of each pair counts. Compaction writes a new snapshot next to the old one and
a marker that names the changes in it; a reader sees one version or the other. The state is a
maximum by time, so a change that is in the snapshot and still in the log does no harm.

Snapshot and log are partitioned by a hash of the pair id: one pair is looked up in one bucket.

    <root>/changes/change=<id>/bucket=<H>/...
    <root>/snapshots/version=<V>/bucket=<H>/...
    <root>/_versions/<V>                            the changes that are in the snapshot
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forgeline import schemas
from forgeline.operators import review
from forgeline.sources import generations

BUCKETS = 64  # fixed for a log; its folders are named after it
STORED = f"{schemas.VERIFICATION}, bucket BIGINT"


def bucket_of(pair_id: Column) -> Column:
    return F.pmod(F.xxhash64(pair_id), F.lit(BUCKETS))


def _write(rows: DataFrame, path: str) -> None:
    stored = rows.select("pair_id", "status", "note", "verified_at", bucket_of(F.col("pair_id")).alias("bucket"))
    stored.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def append(entries: DataFrame, root: str) -> str:
    """Add valid decisions to the log, as a whole or not at all; returns the change's name."""
    spark = entries.sparkSession
    name = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    _write(entries, f"{root}/changes/change={name}")
    generations.mark(spark, f"{root}/_changes/{name}")
    return name


def submit(requests: DataFrame, root: str) -> DataFrame:
    """Append the valid ones of some review requests; returns the rejected ones."""
    valid, rejected = review.verification_entries(requests)
    append(valid, root)
    return rejected


def version(spark: SparkSession, root: str) -> int | None:
    return max(generations.numbers(spark, f"{root}/_versions"), default=None)


def pending_changes(spark: SparkSession, root: str) -> list[str]:
    """Names of the changes that are not in the snapshot."""
    last = version(spark, root)
    inside = set(generations.note_of(spark, f"{root}/_versions/{last}")["changes"]) if last is not None else set()
    return [n for n in generations.names(spark, f"{root}/_changes") if n not in inside]


def _rows(spark: SparkSession, root: str, changes: list[str], last: int | None) -> DataFrame:
    paths = [f"{root}/changes/change={n}" for n in changes]
    if last is not None:
        paths.append(f"{root}/snapshots/version={last}")
    rows = spark.createDataFrame([], STORED)
    for path in paths:  # each has its own bucket folders; a compaction bounds how many there are
        rows = rows.unionByName(spark.read.schema(STORED).parquet(path))
    return rows


def read_state(spark: SparkSession, root: str, pair_id: str | None = None) -> DataFrame:
    """The current decision of every pair, or of one, which reads the bucket of that pair only."""
    rows = _rows(spark, root, pending_changes(spark, root), version(spark, root))
    if pair_id is not None:
        number = spark.range(1).select(bucket_of(F.lit(pair_id))).first()[0]
        rows = rows.filter((F.col("bucket") == number) & (F.col("pair_id") == pair_id))
    return review.current_verification(rows)


def compact(spark: SparkSession, root: str) -> int | None:
    """Write snapshot and log as a new snapshot; returns its version.

    What readers see does not change. Changes that come in meanwhile stay in the log, and a
    compaction that did not get to its marker is written over by the next one. Changes of the
    version before are deleted, so readers of that version finish undisturbed.
    """
    last = version(spark, root)
    changes = pending_changes(spark, root)
    if not changes:
        return last
    number = 0 if last is None else last + 1
    _write(review.current_verification(_rows(spark, root, changes, last)), f"{root}/snapshots/version={number}")
    generations.mark(spark, f"{root}/_versions/{number}", {"changes": changes})
    if last is not None:
        for name in generations.note_of(spark, f"{root}/_versions/{last}")["changes"]:
            generations.remove(spark, f"{root}/_changes/{name}")
            generations.remove(spark, f"{root}/changes/change={name}")
        if last > 0:
            generations.remove(spark, f"{root}/snapshots/version={last - 1}")
            generations.remove(spark, f"{root}/_versions/{last - 1}")
    return number
