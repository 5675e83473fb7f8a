"""Questions the tables answer directly, without a pair builder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgeline.operators.ranking import exact_median, top_k


def review_load(pull_requests: DataFrame) -> DataFrame:
    """Q7: open pull requests awaiting each requested reviewer."""
    asked = pull_requests.filter(F.col("outcome") == "open").select(
        "repo", F.explode("requested_reviewers").alias("reviewer")
    )
    return asked.groupBy("repo", "reviewer").agg(F.count(F.lit(1)).alias("open_reviews"))


def file_creators(touches: DataFrame) -> DataFrame:
    """Q17: login of the first commit per file, by time then sha."""
    first = F.min(F.struct("committed_at", "sha", F.col("author_login").alias("login")))
    return (
        touches.groupBy("repo", "path").agg(first.alias("first")).select("repo", "path", "first.login", "first.sha")
    )


def most_changed_files(touches: DataFrame, k: int = 20) -> DataFrame:
    """Q23: the files of each repo with most commits."""
    counts = touches.groupBy("repo", "path").agg(F.count(F.lit(1)).alias("commits"))
    return top_k(counts, ["repo"], [F.desc("commits"), F.asc("path")], k)


def recently_changed_files(touches: DataFrame, k: int = 20) -> DataFrame:
    """Q21: the files of each repo changed last."""
    last = touches.groupBy("repo", "path").agg(F.max("committed_at").alias("changed_at"))
    return top_k(last, ["repo"], [F.desc("changed_at"), F.asc("path")], k)


def closing_links(pull_requests: DataFrame, issues: DataFrame) -> DataFrame:
    """Q49, Q52: pull requests and the known issues they close."""
    edges = pull_requests.select("repo", F.col("number").alias("pr_number"), "outcome", F.explode("closes_issues").alias("number"))
    return edges.join(issues.select("repo", "number", F.col("state").alias("issue_state")), ["repo", "number"]).select(
        "repo", "pr_number", "outcome", F.col("number").alias("issue_number"), "issue_state"
    )


def longest_waiting(pull_requests: DataFrame, k: int = 20) -> DataFrame:
    """Q51: the oldest open pull requests without any review."""
    waiting = pull_requests.filter((F.col("outcome") == "open") & F.col("hours_to_first_review").isNull())
    return top_k(
        waiting.select("repo", "number", "created_at"), ["repo"], [F.asc("created_at"), F.asc("number")], k
    )


def priorities(issues: DataFrame) -> DataFrame:
    """Q57: issues per priority label and state."""
    return issues.groupBy("repo", "priority_label", "state").agg(F.count(F.lit(1)).alias("n"))


def related_not_duplicate(issues: DataFrame) -> DataFrame:
    """Q58: related references that are not also duplicate references of the issue."""
    return (
        issues.select(
            "repo", "number", F.explode(F.array_except("related_issues", "duplicate_of")).alias("related_number")
        )
    )


def time_to_fix_by_label(issues: DataFrame) -> DataFrame:
    """Q59: exact median hours to close per label."""
    rows = issues.filter("time_to_close_hours IS NOT NULL").select(
        "repo", F.explode("labels").alias("label"), F.col("time_to_close_hours").alias("hours")
    )
    return exact_median(rows, ["repo", "label"], "hours", F.floor("hours"))


def lifecycle(issues: DataFrame) -> DataFrame:
    """Q60: every dated event of an issue, one row each."""
    at = F.col("at")
    event = "struct<at:timestamp, kind:string, detail:string>"

    def listed(history: str, kind: str, detail: str):
        return F.transform(
            history,
            lambda e: F.struct(
                e["at"].alias("at"), F.lit(kind).alias("kind"), e[detail].cast("string").alias("detail")
            ).cast(event),
        )

    opened = F.array(F.struct(F.col("created_at").alias("at"), F.lit("opened").alias("kind"), F.col("reporter").alias("detail")).cast(event))
    closed = F.array(F.struct(F.col("closed_at").alias("at"), F.lit("closed").alias("kind"), F.lit(None).cast("string").alias("detail")).cast(event))
    events = F.concat(
        opened,
        listed("label_history", "labeled", "label"),
        listed("assignment_history", "assigned", "assignee"),
        listed("cross_refs", "referenced", "ref_number"),
        closed,
    )
    return issues.select("repo", "number", F.inline(events)).filter(at.isNotNull())
