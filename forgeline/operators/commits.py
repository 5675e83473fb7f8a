"""Commits: landed record to analysis row, and the commit-by-file table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgeline.functions import refs
from forgeline.functions.text import or_empty
from forgeline.functions.times import parse_iso
from forgeline.sources import fan_out


def join_commit_details(listing: DataFrame, details: DataFrame) -> DataFrame:
    """Details of the listed commits; a commit whose detail is missing is left out."""
    return details.join(listing.select("repo", "sha").distinct(), ["repo", "sha"], "left_semi")


def normalise_commits(raw: DataFrame, strict_closing: bool = False) -> DataFrame:
    """Landed commit details to the ``commits`` table. Narrow: no shuffle."""

    def total(field: str):
        amounts = F.coalesce(F.col(f"files.{field}"), F.array().cast("array<bigint>"))
        return F.aggregate(amounts, F.lit(0).cast("bigint"), lambda acc, n: acc + F.coalesce(n, F.lit(0)))

    message = F.col("commit.message")
    return raw.select(
        "repo",
        "sha",
        message.alias("message"),
        F.col("commit.author.name").alias("author_name"),
        F.col("commit.author.email").alias("author_email"),
        F.col("author.login").alias("author_login"),
        parse_iso(F.col("commit.author.date")).alias("committed_at"),
        or_empty(F.col("files.filename")).alias("files_changed"),
        total("additions").alias("additions"),
        total("deletions").alias("deletions"),
        or_empty(F.col("parents.sha")).alias("parents"),
        refs.commit_refs(message, strict_closing).alias("closes_issues"),
    ).withColumn("is_bug_fix", refs.is_bug_fix(F.col("message"), F.col("closes_issues")))


def touches(commits: DataFrame) -> DataFrame:
    """One row per commit and file, the input of ownership and history jobs."""
    return commits.select(
        "repo",
        "sha",
        "author_login",
        "committed_at",
        "is_bug_fix",
        "closes_issues",
        F.explode("files_changed").alias("path"),
    )


def write_history(raw: DataFrame, root: str) -> None:
    """The ``commits`` and ``touches`` tables of the landed commits' repos, from one scan of them.

    Commits are published last, so a repo that has them has its touches too.
    """
    rows = normalise_commits(raw)
    commit = F.struct(*rows.columns)
    touched = ["repo", "sha", "author_login", "committed_at", "is_bug_fix", "closes_issues"]
    touch = F.transform("files_changed", lambda path: F.struct(*touched, path.alias("path")))
    fan_out.write(rows, root, {"touches": touch, "commits": F.array(commit)})


def commit_graph(commits: DataFrame) -> DataFrame:
    """Parent edges: (repo, sha, parent_sha)."""
    return commits.select("repo", "sha", F.explode("parents").alias("parent_sha"))
