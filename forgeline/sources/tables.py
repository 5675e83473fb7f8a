"""Table input and output: JSON lines at the edges, Parquet by repo inside."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forgeline.functions.json_text import KEEP_NULLS
from forgeline.functions.text import repo_folder
from forgeline.session import new_run_folder

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _unless_missing(read: Callable[[], DataFrame], spark: SparkSession, schema: str) -> DataFrame:
    """The DataFrame, or an empty one of the schema when the path does not exist."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a declared schema; blank lines are skipped, a missing path is empty.

    The path may be a glob, such as ``<root>/*/natural_qa_pairs.jsonl``.
    """
    # A line that is not JSON fails the job, as a damaged dataset should.
    reader = spark.read.schema(schema).option("mode", "FAILFAST")
    return _unless_missing(lambda: reader.json(path), spark, schema)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines with nulls written out."""
    df.write.mode(mode).options(**KEEP_NULLS).json(path)


def read_table(spark: SparkSession, path: str, schema: str, repos: list[str] | None = None) -> DataFrame:
    """A dataset partitioned by repo; ``repos`` prunes to those partitions."""
    full = f"{schema}, repo_dir STRING"
    stored = _unless_missing(lambda: spark.read.schema(full).parquet(path), spark, full)
    if repos is not None:
        stored = stored.filter(F.col("repo_dir").isin([r.replace("/", "__") for r in repos]))
    return stored.drop("repo_dir")


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write partitioned by repo. Overwriting replaces only the repos present in ``df``.

    The repo stays a column; the folder name is its form without slashes. Rows are
    rebalanced on the folder with adaptive splitting, so a large repo is written by
    many tasks and a small one by few.
    """
    (
        df.withColumn("repo_dir", repo_folder(F.col("repo")))
        .hint("rebalance", "repo_dir")
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("repo_dir")
        .parquet(path)
    )


def drop_repos(spark: SparkSession, path: str, repos: list[str]) -> None:
    """Remove the repos' rows from a dataset; repos without any are passed over."""
    for repo in repos:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/repo_dir={repo.replace('/', '__')}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    refresh(spark, path)


def replace_repos(df: DataFrame, path: str, repos: list[str]) -> None:
    """Write ``df`` as all there is of the given repos; those without rows in it end up empty."""
    write_table(df, path)
    present = {r["repo"] for r in df.select("repo").filter(F.col("repo").isin(repos)).distinct().collect()}
    drop_repos(df.sparkSession, path, [r for r in repos if r not in present])


def missing_repos(spark: SparkSession, path: str, repos: list[str]) -> list[str]:
    """Repos without rows in the dataset, from one listing of its folders; no job runs.

    A folder is there only if a committed write had rows for it.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    present = {unquote(s.getPath().getName()) for s in fs.listStatus(root)} if fs.exists(root) else set()
    return [r for r in repos if f"repo_dir={r.replace('/', '__')}" not in present]


def write_new_repos(df: DataFrame, path: str, repos: list[str]) -> list[str]:
    """Write only repos that have no data yet; returns those written."""
    todo = missing_repos(df.sparkSession, path, repos)
    if todo:
        write_table(df.filter(F.col("repo").isin(todo)), path)
    return todo


def only_repos(df: DataFrame, repos: list[str] | None) -> DataFrame:
    """Rows of the configured repos; None keeps all."""
    return df if repos is None else df.filter(F.col("repo").isin(repos))


def append_ledger(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def read_ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return _unless_missing(lambda: spark.read.schema(schema).parquet(path), spark, schema).distinct()


def export_jsonl(df: DataFrame, path: str) -> None:
    write_jsonl(df, path, "overwrite")


def refresh(spark: SparkSession, path: str) -> None:
    """Forget cached file listings and data of a path."""
    spark.catalog.refreshByPath(path)


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate result to the shared folder and read it back.

    Later steps then start from files that outlive executors, compute it once, and
    the optimizer plans joins with its real size. Shuffle files of the write go with it, not
    when the driver happens to collect its garbage.
    """
    return settle_at(df, new_run_folder(df.sparkSession, name), drop_shuffles=True)


def settle_at(df: DataFrame, path: str, drop_shuffles: bool = False) -> DataFrame:
    """As :func:`settle`, in a given new folder."""
    conf = df.sparkSession.conf
    before = conf.get(SHUFFLE_CLEANUP)
    conf.set(SHUFFLE_CLEANUP, str(drop_shuffles).lower())
    try:
        df.write.parquet(path)
    finally:
        conf.set(SHUFFLE_CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table. All that was made of it must be written."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
