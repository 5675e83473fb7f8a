"""Who changed what: file ownership, expertise by path, last modifier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgeline.functions.text import is_shallow, present
from forgeline.operators.ranking import nest, top_k


def file_authors(touches: DataFrame) -> DataFrame:
    """Commits per (repo, filepath, login); a null login keeps its own row."""
    return touches.groupBy("repo", F.col("path").alias("filepath"), F.col("author_login").alias("login")).agg(
        F.count(F.lit(1)).alias("commits")
    )


def file_ownership(touches: DataFrame) -> DataFrame:
    """Commit count and sorted distinct authors per file.

    Authors are made distinct with partial aggregation first, so the second step
    receives one row per (file, author), not one per commit.
    """
    return (
        file_authors(touches)
        .groupBy("repo", "filepath")
        .agg(
            F.sum("commits").alias("total_commits"),
            # collect_list skips the null login
            F.array_sort(F.collect_list("login")).alias("unique_authors"),
        )
    )


def commits_per_author(commits: DataFrame) -> DataFrame:
    return (
        commits.filter(present(F.col("author_login")))
        .groupBy("repo", F.col("author_login").alias("login"))
        .agg(F.count(F.lit(1)).alias("total_commits"))
    )


def path_expertise(touches: DataFrame) -> DataFrame:
    """Touches per (repo, login, path) where path is a file or any directory above it.

    The roll-up happens before the one shuffle; directories combine on the map side.
    """
    levels = F.sequence(F.lit(1), F.size(F.split("path", "/")))
    rolled = (
        touches.filter(present(F.col("author_login")))
        .select("repo", F.col("author_login").alias("login"), "path", F.explode(levels).alias("level"))
        # the first n parts of the path: a directory, or the file at its full depth
        .withColumn("path", F.expr("substring_index(path, '/', level)"))
    )
    return rolled.groupBy("repo", "login", "path").agg(F.count(F.lit(1)).alias("commits"))


def top_paths(touches: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` most touched paths of each author, ties by path."""
    return top_paths_of(path_expertise(touches), k)


def top_paths_of(expertise: DataFrame, k: int = 20) -> DataFrame:
    """As :func:`top_paths`, from a roll-up that is there already."""
    return top_k(expertise, ["repo", "login"], [F.desc("commits"), F.asc("path")], k)


def paths_of_profiles(profiles: DataFrame) -> DataFrame:
    """The rows of :func:`top_paths` read back from the ``contributors`` table."""
    rows = profiles.select("repo", "login", F.posexplode("top_files").alias("at", "f"))
    return rows.select(
        "repo", "login", F.col("f.file").alias("path"), "f.commits", (F.col("at") + 1).alias("rank")
    )


def top_directories(paths: DataFrame) -> DataFrame:
    """The shallow ones among an author's top paths."""
    return paths.filter(is_shallow(F.col("path")))


def path_experts(expertise: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` authors with most touches per path, from :func:`path_expertise`: all who touched it compete."""
    return top_k(
        expertise.select("repo", "login", "path", "commits"),
        ["repo", "path"],
        [F.desc("commits"), F.asc("login")],
        k,
    )


def file_experts(expertise: DataFrame, k: int = 5) -> DataFrame:
    """One row per path with its experts as an array of at most ``k``."""
    ranked = path_experts(expertise, k)
    return nest(ranked, ["repo", "path"], F.struct("login", "commits"), "rank", "experts").select(
        "repo", F.col("path").alias("file"), "experts"
    )


def latest_modifier(touches: DataFrame) -> DataFrame:
    """Login of the last commit per file, by time then sha; may be null."""
    last = F.max(F.struct("committed_at", "sha", F.col("author_login").alias("login")))
    return (
        touches.groupBy("repo", "path")
        .agg(last.alias("last"))
        .select("repo", F.col("path").alias("file"), F.col("last.login").alias("login"))
    )
