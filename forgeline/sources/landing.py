"""Landed raw records: nested JSON as fetched from the hosting service."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forgeline import schemas
from forgeline.operators.commits import join_commit_details
from forgeline.settings import LANDED_LIMITS
from forgeline.sources.tables import read_jsonl

SCHEMAS = {
    "issues": schemas.RAW_ISSUE,
    "pull_requests": schemas.RAW_PULL_REQUEST,
    "discussions": schemas.RAW_DISCUSSION,
    "commits": schemas.RAW_COMMIT,
    "commit_listing": schemas.RAW_COMMIT_LISTING,
    "ci_runs": schemas.RAW_CI_RUN,
    "ci_jobs": schemas.RAW_CI_JOB,
}

# Columns without which a landed record is of no use.
REQUIRED = {
    "issues": ["repo", "number"],
    "pull_requests": ["repo", "number"],
    "discussions": ["repo", "number"],
    "commits": ["repo", "sha"],
    "commit_listing": ["repo", "sha"],
    "ci_runs": ["repo", "id"],
    "ci_jobs": ["repo", "run_id"],
}


def read_landed(spark: SparkSession, root: str, kind: str) -> DataFrame:
    return read_jsonl(spark, f"{root}/{kind}", SCHEMAS[kind])


def read_landed_commits(spark: SparkSession, root: str) -> DataFrame:
    """Commit details that the commit listing names."""
    return join_commit_details(
        read_landed(spark, root, "commit_listing"), read_landed(spark, root, "commits")
    )


def stream_landed(spark: SparkSession, root: str, kind: str, files_per_batch: int = 1000) -> DataFrame:
    """The same records as a stream of arriving files."""
    return (
        spark.readStream.schema(SCHEMAS[kind])
        .option("maxFilesPerTrigger", files_per_batch)
        .json(f"{root}/{kind}")
    )


def _first(column: str, limit: str):
    return F.slice(F.col(column), 1, LANDED_LIMITS[limit])


def bounded_issues(raw: DataFrame) -> DataFrame:
    """Issues with nested lists cut to what one request of the service returns."""
    return (
        raw.withColumn("labels", F.struct(_first("labels.nodes", "labels").alias("nodes")))
        .withColumn("assignees", F.struct(_first("assignees.nodes", "assignees").alias("nodes")))
        .withColumn(
            "comments",
            F.struct("comments.totalCount", _first("comments.nodes", "issue_comments").alias("nodes")),
        )
        .withColumn("timelineItems", F.struct(_first("timelineItems.nodes", "timeline").alias("nodes")))
    )


def bounded_pull_requests(raw: DataFrame) -> DataFrame:
    threads = F.transform(
        _first("reviewThreads.nodes", "review_threads"),
        lambda t: F.struct(
            F.struct(
                F.slice(t["comments"]["nodes"], 1, LANDED_LIMITS["thread_comments"]).alias("nodes")
            ).alias("comments")
        ),
    )
    return (
        raw.withColumn("labels", F.struct(_first("labels.nodes", "labels").alias("nodes")))
        .withColumn(
            "reviewRequests", F.struct(_first("reviewRequests.nodes", "review_requests").alias("nodes"))
        )
        .withColumn("reviews", F.struct(_first("reviews.nodes", "reviews").alias("nodes")))
        .withColumn("reviewThreads", F.struct(threads.alias("nodes")))
    )


def bounded_discussions(raw: DataFrame) -> DataFrame:
    return raw.withColumn(
        "comments",
        F.struct("comments.totalCount", _first("comments.nodes", "discussion_comments").alias("nodes")),
    )
